"""Tables of measured throughput: benchmark scores, profile logs, baseline files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the benchmark table (fixed values): a data set and its score with each topology.
BENCHMARK_COLUMNS = ("dataset", "graphy3b11l", "graphy3b11l_256hz", "b2l444", "b2l66", "b22l333", "b3l433", "b3l55", "b4l333")
#: Algorithm names of the first baseline layout (fixed values), by the start of its variant names.
VARIANT_ALGORITHMS = (("bfs", "sssp"), ("pr", "pagerank"), ("cc", "connected_components"))
FAILED = ("ERROR", "PARSE_FAIL", "SCRIPT_ERR", "")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark scores: the data set, c3l11 (the better of its two columns) and the other topologies. What is no number
    is null; a header other than ``BENCHMARK_COLUMNS`` is an error."""
    raw = spark.read.csv(path, sep="\t", header=True)
    if tuple(raw.columns) != BENCHMARK_COLUMNS:
        raise ValueError(f"unknown header {raw.columns}")
    number = lambda c: F.trim(c).try_cast("double")
    first, second, *rest = BENCHMARK_COLUMNS[1:]
    return raw.where(F.coalesce(F.trim("dataset"), F.lit("")) != "").select(F.trim("dataset").alias("dataset"), F.greatest(number(first), number(second)).alias("c3l11"), *(number(c).alias(c) for c in rest))


def _after(mark: str) -> Column:
    return F.regexp_extract("value", mark + r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def read_profile_logs(spark: SparkSession, path: str) -> DataFrame:
    """A row per ``*.log`` file below ``path``: log, vertices, edges, total_mteps (the first given), and the average
    throughput of its sparse and its dense groups."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(path).select(F.input_file_name().alias("log"), F.monotonically_increasing_id().alias("at"), "value")
    total = _after(r"Total MTEPS \(Edges / Total Time\): ")
    speed = _after("Throughput = ")
    graph = r"Global graph has ([0-9]+) vertices and ([0-9]+) edges"
    size = lambda i: F.max(F.regexp_extract("value", graph, i).try_cast("bigint"))
    return lines.groupBy("log").agg(
        size(1).alias("vertices"),
        size(2).alias("edges"),
        F.min_by(total, F.when(total.isNotNull(), F.col("at"))).alias("total_mteps"),
        F.avg(F.when(F.col("value").contains("Sparse Group"), speed)).alias("sparse_throughput"),
        F.avg(F.when(F.col("value").contains("Dense Group"), speed)).alias("dense_throughput"),
    )


def _dataset(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^.*/", ""), r"(?i)\.(txt|mtx)$", "")


def read_throughput(spark: SparkSession, path: str | list[str], layout: str) -> DataFrame:
    """(dataset, algorithm, throughput_mteps) of baseline files. Layout "variant" has the columns dataset, variant
    and total_mteps, and rows of unknown variants are dropped; layout "mode" has Dataset, APP_MODE and MTEPS, and
    failed rows are dropped."""
    raw = spark.read.csv(path, header=True)
    if layout == "variant":
        head = F.lower(F.split("variant", "_")[0])
        algorithm = F.coalesce(*(F.when(head == v, F.lit(a)) for v, a in VARIANT_ALGORITHMS))
        return raw.select(_dataset(F.col("dataset")).alias("dataset"), algorithm.alias("algorithm"), F.col("total_mteps").alias("throughput_mteps")).where("algorithm IS NOT NULL")
    if layout == "mode":
        speed = F.coalesce(F.trim("MTEPS"), F.lit(""))
        return raw.where(~speed.isin(*FAILED)).select(_dataset(F.col("Dataset")).alias("dataset"), F.lower(F.trim("APP_MODE")).alias("algorithm"), speed.alias("throughput_mteps"))
    raise ValueError(f"unknown layout {layout}")
