"""Statistics and edges of graph files, kept by what the files are."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gasframe.operators.graph import Graph
from gasframe.operators.statistics import statistics
from gasframe.sources.graphs import EmptyGraph, read_edges, with_defaults

#: Goes into every key: what another version has kept is not read.
VERSION = 2
#: Edges of a block, about: a range of sources that are kept and read together.
BLOCK_EDGES = 1 << 20


def file_key(spark: SparkSession, path: str) -> str:
    """A key of a file or folder: its path, and the number, lengths and latest change of its files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(p)
    status = fs.getFileStatus(p)
    latest = max([status.getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])
    facts = f"{VERSION}|{fs.makeQualified(p)}|{size.getFileCount()}|{size.getLength()}|{latest}"
    return hashlib.sha256(facts.encode()).hexdigest()[:32]


def _there(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


class Adjacency:
    """The edges of a raw graph file in blocks: ranges of sources, each with its edges sorted by source and destination,
    so that ids are coded as small differences, in a folder of its own; and an index (block, low, high, sources, edges).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.edges = spark.read.parquet(f"{path}/blocks")
        self.index = spark.read.parquet(f"{path}/index")

    def of(self, sources: list[int]) -> DataFrame:
        """The edges of some sources, a list of ids; only the blocks that hold any are read."""
        blocks = self.index.where(F.expr(" OR ".join(f"{int(i)} BETWEEN low AND high" for i in sources) or "false")).select("block").collect()
        return self.edges.where(F.col("block").isin([r.block for r in blocks]) & F.col("src").isin(list(sources))).drop("block")

    def graph(self, app: str) -> Graph:
        """The graph for a built-in program, as ``read_graph`` makes it."""
        return with_defaults(self.edges.drop("block"), app)


def cached_graph(spark: SparkSession, path: str, folder: str) -> Adjacency:
    """The edges of the .txt, .mtx or Parquet file at ``path`` from ``folder``, where they are put if they are not there:
    after the first time, no text is read. ``EmptyGraph`` if there is no edge."""
    at = f"{folder.rstrip('/')}/{file_key(spark, path)}.graph"
    if not _there(spark, f"{at}/index"):
        edges = read_edges(spark, path)
        total = edges.count()
        if not total:
            raise EmptyGraph(path)
        # Ranges of sources hold as many edges each; a source of very many has a range of its own.
        blocks = edges.repartitionByRange(-(-total // BLOCK_EDGES), "src").withColumn("block", F.spark_partition_id())
        blocks = blocks.sortWithinPartitions("block", "src", "dst", "eid")
        blocks.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").partitionBy("block").parquet(f"{at}/blocks")
        kept = spark.read.parquet(f"{at}/blocks").groupBy("block").agg(F.min("src").alias("low"), F.max("src").alias("high"), F.countDistinct("src").alias("sources"), F.count("*").alias("edges"))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{at}/index")
    return Adjacency(spark, at)


def cached_statistics(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """``statistics`` of the graph file at ``path``, from ``folder`` if they lie there, and else computed and written
    to it. A file that has changed has another key."""
    at = f"{folder.rstrip('/')}/{file_key(spark, path)}.parquet"
    if not _there(spark, at):
        edges = read_edges(spark, path)
        nodes = edges.selectExpr("src AS id").union(edges.selectExpr("dst AS id")).distinct()
        statistics(Graph(nodes, edges)).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
