"""Degree statistics of a graph, and how its destinations are dealt to partitions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gasframe.operators.graph import Graph


def degrees(graph: Graph) -> DataFrame:
    """(id, in_degree, out_degree) of every node, zeros included."""
    ins = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    outs = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return graph.nodes.select("id").join(ins, "id", "left").join(outs, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def _histogram(d: DataFrame, col: str) -> DataFrame:
    """(v, n, upto): how many nodes have degree v, and how many v or less. Its rows are different degrees, a small
    set of which one window can hold the running count."""
    counts = d.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))


def _side(d: DataFrame, col: str, total: Column) -> list[Column]:
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n")
    n, s = F.max("total"), F.sum(F.col("v") * F.col("n"))
    first = F.col("upto") - F.col("n")
    ranked = F.sum(F.col("v") * (F.col("n") * (first + F.col("upto") + 1) / 2))

    def quantile(q: float) -> Column:
        at = F.floor((F.col("total") - 1) * q + 0.5) + 1
        return F.min(F.when(F.col("upto") >= at, F.col("v")))

    def share(p: float) -> Column:
        top = F.greatest(F.lit(1), F.ceil(F.col("total") * p))
        taken = F.least(F.col("n"), F.greatest(top - (F.col("total") - F.col("upto")), F.lit(0)))
        return F.sum(F.col("v") * taken) / F.greatest(F.max("edges"), F.lit(1))

    return [
        F.max("v").alias(f"max_{col}"),
        (F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)) / n).alias(f"active_{col}"),
        F.when(mean > 0, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / mean).otherwise(0.0).alias(f"cv_{col}"),
        quantile(0.9).alias(f"p90_{col}"),
        quantile(0.99).alias(f"p99_{col}"),
        share(0.01).alias(f"top1pct_{col}"),
        share(0.001).alias(f"top01pct_{col}"),
        F.when(s > 0, F.greatest(2 * ranked / (n * s) - (n + 1) / n, F.lit(0.0))).otherwise(0.0).alias(f"gini_{col}"),
    ]


def statistics(graph: Graph) -> DataFrame:
    """One row: nodes, edges, average degree, density, and for in- and out-degrees the maximum, the share of nodes with
    any, the coefficient of variation, the nearest-rank 90th and 99th percentiles, the edge shares of the top 1 % and
    0.1 % of nodes, and the Gini coefficient.

    All come from histograms of degrees, so that no node list is sorted.
    """
    d = degrees(graph)
    both = d.agg(F.count("*").alias("total"), F.sum("in_degree").alias("edges"))
    v, e = F.col("total"), F.coalesce("edges", F.lit(0))
    out = both.select(v.alias("nodes"), e.cast("bigint").alias("edges"), F.when(v > 0, e / v).otherwise(0.0).alias("avg_degree"), F.when(v > 1, e / (v.cast("double") * (v - 1))).otherwise(0.0).alias("density"))
    for col in ("in_degree", "out_degree"):
        hist = _histogram(d, col).join(F.broadcast(both))
        out = out.join(F.broadcast(hist.agg(*_side(hist, col, v))))
    return out


def in_degrees_descending(graph: Graph) -> DataFrame:
    """(id, in_degree) of the nodes with an incoming edge, most first, then by id."""
    return degrees(graph).where("in_degree > 0").select("id", "in_degree").orderBy(F.desc("in_degree"), "id")


#: Destinations that a partition of a dense and of a sparse group holds; edges per millisecond of their pipelines.
DENSE_CAP, SPARSE_CAP = 65_536, 524_288
SPARSE_RATE, DENSE_RATE = 280_000, 1_040_000


def _running(graph: Graph) -> DataFrame:
    """(id, d, rank, before): nodes with edges by falling in-degree, and the edges of those before each.

    Degrees repeat, so that ranks and running sums come from a histogram of degrees and a rank among the nodes of one
    degree, within blocks of ids.
    """
    d = degrees(graph).where("in_degree > 0").select("id", F.col("in_degree").alias("d"))
    blocks = d.withColumn("block", F.expr("id div 65536"))
    counts = blocks.groupBy("d", "block").agg(F.count("*").alias("n"))
    whole = counts.groupBy("d").agg(F.sum("n").alias("n"))
    down = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("d", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("nodes_before"), F.coalesce(F.sum(F.col("n") * F.col("d")).over(down), F.lit(0)).alias("edges_before"))
    inner = Window.partitionBy("d").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("d", "block", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("skip"))
    place = Window.partitionBy("d", "block").orderBy("id")
    ranked = blocks.withColumn("i", F.row_number().over(place) - 1).join(offsets, ["d", "block"]).join(starts, "d")
    at = F.col("skip") + F.col("i")
    return ranked.select("id", "d", (F.col("nodes_before") + at).alias("rank"), (F.col("edges_before") + at * F.col("d")).alias("before"))


def partition_plan(graph: Graph, sparse_groups: int, dense_groups: int, sparse_rate: int = SPARSE_RATE, dense_rate: int = DENSE_RATE, sparse_cap: int = SPARSE_CAP, dense_cap: int = DENSE_CAP) -> DataFrame:
    """(id, in_degree, is_dense, group_id, partition_id) of every destination.

    Destinations by falling in-degree go to the dense groups until those have their share of the edges, by throughput;
    the rest goes to the sparse groups. Within a class they are dealt round, and a group opens a new partition when it
    holds as many destinations as fit.
    """
    if sparse_groups + dense_groups <= 0:
        raise ValueError("a plan needs a group")
    run = _running(graph)
    total = run.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("total"))
    power = dense_groups * dense_rate + sparse_groups * sparse_rate
    cut = F.col("total") * (dense_groups * dense_rate / power)
    dense = F.lit(bool(dense_groups)) & ((F.col("before") < cut) | F.lit(sparse_groups == 0))
    marked = run.join(F.broadcast(total)).withColumn("is_dense", dense)
    return _dealt(marked, sparse_groups, dense_groups, sparse_cap, dense_cap)


def naive_plan(graph: Graph, sparse_groups: int, dense_groups: int, dense_share: float = 0.2, sparse_cap: int = SPARSE_CAP, dense_cap: int = DENSE_CAP) -> DataFrame:
    """Like ``partition_plan``, with a fixed share of the destinations in the dense class, whatever their edges."""
    run = _running(graph)
    total = run.agg(F.count("*").alias("total"))
    dense = F.lit(bool(dense_groups)) & ((F.col("rank") < F.ceil(F.col("total") * dense_share)) | F.lit(sparse_groups == 0))
    return _dealt(run.join(F.broadcast(total)).withColumn("is_dense", dense), sparse_groups, dense_groups, sparse_cap, dense_cap)


def _dealt(marked: DataFrame, sparse_groups: int, dense_groups: int, sparse_cap: int, dense_cap: int) -> DataFrame:
    heads = marked.where("is_dense").agg(F.count("*").alias("dense_nodes"))
    own = F.when(F.col("is_dense"), F.col("rank")).otherwise(F.col("rank") - F.col("dense_nodes"))
    groups = F.when(F.col("is_dense"), F.lit(max(dense_groups, 1))).otherwise(F.lit(max(sparse_groups, 1)))
    cap = F.when(F.col("is_dense"), F.lit(dense_cap)).otherwise(F.lit(sparse_cap))
    return marked.join(F.broadcast(heads)).select("id", F.col("d").alias("in_degree"), "is_dense", (own % groups).cast("bigint").alias("group_id"), F.floor(F.floor(own / groups) / cap).cast("bigint").alias("partition_id"))


def partition_loads(plan: DataFrame) -> DataFrame:
    """(is_dense, group_id, partition_id, destinations, edges) of each partition of a plan."""
    return plan.groupBy("is_dense", "group_id", "partition_id").agg(F.count("*").alias("destinations"), F.sum("in_degree").alias("edges"))


