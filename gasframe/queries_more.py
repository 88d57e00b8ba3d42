"""Queries of readers, sinks and caches on files made from the tables, and of ways to end a run, with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gasframe.algorithms import INF, LOW, PROGRAMS, bfs_depth
from gasframe.operators.graph import DEFAULT_STEPS, Graph, Until, converge_until, gathered, iterate, run, scattered
from gasframe.plans.superstep_plan import lower
from gasframe.queries import _CLICKS, _FAR, _NODES, _PURCHASE, _SUPPLY, PART, _far_from_zero, _long, _ratings, _start, _table, _unrolled, _with_degree, clickflow, purchase, supply
from gasframe.sources import cache, graphs, tables
from gasframe.sources.scratch import shared_dir


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey)


def _host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines ``customer supplier [weight [cost]]``, numbered from one, loaded as a host program does: of each
    node its edges and the sums of their properties."""
    path, line = _path(spark, "host.txt"), F.col("l_linenumber")
    _orders(spark, sf_dir).select(F.concat_ws(" ", F.col("o_custkey") + 1, F.col("l_suppkey") + 1, F.when(line > 1, line), F.when(line > 2, F.col("l_orderkey") % 5)).alias("value")).write.text(path)
    g = graphs.read_host_graph(spark, path, ("weight", "cost"))
    sums = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"), F.sum("cost").alias("cost"))
    return g.nodes.select("id").join(sums, "id", "left").fillna(0)


def _graph_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines, some without a weight, read as a graph for shortest paths with all ids up to the largest: of each
    node its first distance and the weights that lead to it."""
    path, line = _path(spark, "plain.txt"), F.col("l_linenumber")
    _orders(spark, sf_dir).select(F.concat_ws("\t", "o_custkey", "l_suppkey", F.when(line > 1, line)).alias("value")).write.text(path)
    g = graphs.read_graph(spark, path, "sssp", dense_ids=True)
    sums = g.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("weight"))
    return g.nodes.join(sums, "id", "left").select("id", "dist", F.coalesce("weight", F.lit(0)).alias("weight"))


def _results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees of the purchase graph, written as one JSON object, and its members read back."""
    path = _path(spark, "results")
    graphs.write_results_json(_with_degree(purchase(spark, sf_dir)).nodes, "out_deg", path)
    member = r'^,?"(-?\d+)":(-?\d+)$'
    lines = spark.read.text(path).where(F.col("value").rlike(member))
    return lines.select(*(F.regexp_extract("value", member, i).cast("bigint").alias(c) for i, c in ((1, "id"), (2, "out_deg"))))


def _cached_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as an edge list, kept in blocks of sources; read from the blocks."""
    path, folder = _path(spark, "raw.txt"), _path(spark, "cache")
    purchase(spark, sf_dir).edges.select(F.concat_ws(" ", "src", "dst", F.col("eid") % 7).alias("value")).write.text(path)
    cache.cached_graph(spark, path, folder)
    return cache.cached_graph(spark, path, folder).edges.select("src", "dst", "weight")


def _dropped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths where every third part is no node: what is sent to it is dropped, and it sends nothing."""
    g = supply(spark, sf_dir)
    held = Graph(g.nodes.where((F.col("id") < PART) | (F.col("id") % 3 > 0)), g.edges)
    return run(PROGRAMS["sssp"], _start(held, dist=_far_from_zero())).nodes.select("id", "dist")


#: Steps at most, and the move below which a run of page rank may end.
_RANK_STEPS, _MOVE = 12, 0.05


def _delta_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rank until no rank moves by a twentieth."""
    g = _start(_with_degree(clickflow(spark, sf_dir)), rank=F.lit(1.0))
    return converge_until(PROGRAMS["pagerank"], g, _RANK_STEPS, Until("delta", threshold=_MOVE)).nodes.select("id", F.round("rank", 6).alias("rank"))


def _improving_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of neighbours alone, of which a node takes what is less than its own, until none improves."""
    return converge_until(PROGRAMS["cc"], _start(clickflow(spark, sf_dir), label=F.col("id")), DEFAULT_STEPS, Until("improve", "min")).nodes.select("id", "label")


def _newly_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first depths from user 1 until a step discovers nobody."""
    g = _start(clickflow(spark, sf_dir), prop=F.when(F.col("id") == 1, _long((1 << 31) + 1)).otherwise(_long(INF)))
    return bfs_depth(converge_until(PROGRAMS["bfs"], g, DEFAULT_STEPS, Until("newly_discovered", active_mask=1 << 31, unreached=INF)).nodes)


def _vector_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of the vectors that reach a node, scaled by ratings: (id, i, x)."""
    nodes = iterate(PROGRAMS["vector_sum"], _ratings(spark, sf_dir), 1).nodes
    return nodes.select("id", F.posexplode("vec").alias("i", "x")).select("id", F.col("i").cast("bigint").alias("i"), F.round("x", 3).alias("x"))


def _als_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the vectors of a least-squares step are from solving their nodes' equations."""
    g, step = _ratings(spark, sf_dir), lower(PROGRAMS["als"])
    sums, _ = gathered(step, *scattered(step, g.nodes, g.edges))
    both = iterate(PROGRAMS["als"], g, 1).nodes.join(sums, F.col("id") == F.col("k"))
    a, b, x, places = F.col("g._0.data"), F.col("g._1"), F.col("vec"), F.sequence(F.lit(0), F.lit(15))
    left = lambda i: F.aggregate(places, F.get(x, i) * 1e-6, lambda s, j: s + F.get(a, i * 16 + j) * F.get(x, j))
    return both.select("id", F.round(F.array_max(F.transform(places, lambda i: F.abs(left(i) - F.get(b, i)))), 3).alias("residual"))


def _benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a table of benchmark scores, with what is no number among them."""
    s, path = _table(spark, sf_dir, "supplier"), _path(spark, "scores")
    text = lambda c: c.cast("string")
    scores = [text(F.col("s_suppkey")), text(F.col("s_nationkey") * 100), F.when(F.col("s_nationkey") % 2 == 0, text(F.col("s_nationkey"))).otherwise(F.lit("bus error")), F.lit(None).cast("string"), F.lit(" 2.5 "), text(F.col("s_suppkey") % 7), F.lit("x"), F.lit("4")]
    s.select(*(c.alias(n) for c, n in zip([F.col("s_name"), *scores], tables.BENCHMARK_COLUMNS))).write.csv(path, sep="\t", header=True)
    return tables.read_benchmark(spark, path)


def _throughput_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a baseline file, some of its rows failed."""
    path = _path(spark, "baseline")
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/data/"), "c_name", F.lit(".TXT")).alias("Dataset"), F.upper("c_mktsegment").alias("APP_MODE"), F.when(F.col("c_nationkey") % 4 == 0, F.lit("ERROR")).otherwise(F.col("c_nationkey").cast("string")).alias("MTEPS"))
    rows.write.csv(path, header=True)
    return tables.read_throughput(spark, path, "mode")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "host_graph": _host_graph,
    "graph_defaults": _graph_defaults,
    "results_sink": _results_sink,
    "cached_edges": _cached_edges,
    "dropped_keys": _dropped_keys,
    "delta_ranks": _delta_ranks,
    "improving_labels": _improving_labels,
    "newly_discovered": _newly_discovered,
    "vector_sums": _vector_sums,
    "als_residual": _als_residual,
    "benchmark_table": _benchmark_table,
    "throughput_table": _throughput_table,
}

_LINES = "SELECT o_custkey AS src, l_suppkey AS dst, l_linenumber, l_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_WHOLE = "v AS (SELECT unnest(range((SELECT max(greatest(src, dst)) FROM e) + 1)) AS id)"
_VECTORS = """w AS (SELECT vec_id AS id, list_transform(range(1, 17), lambda i: list_sum(list_transform(range(0, len(embedding) // 16), lambda j: embedding[i + 16 * j]::DOUBLE))) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM w), e AS (SELECT (id * 7 + 13 * j + 1) % n AS src, id AS dst FROM w, n, range(1, 6) r(j))"""


def _delta_sql(steps: int) -> str:
    """Page rank that stands still from the step on after which no rank has moved by ``_MOVE``."""
    ctes = [_CLICKS, _NODES, "n0 AS MATERIALIZED (SELECT id, out_deg, 1.0::DOUBLE AS x, false AS done FROM d)"]
    for i in range(steps):
        ctes.append(f"a{i} AS (SELECT dst, sum(x) AS g FROM e JOIN n{i} ON src = id GROUP BY dst)")
        ctes.append(f"b{i} AS MATERIALIZED (SELECT id, out_deg, done, x, CASE WHEN dst IS NULL OR done THEN x ELSE 0.15::DOUBLE + 0.85::DOUBLE * (g / out_deg) END AS y FROM n{i} LEFT JOIN a{i} ON id = dst)")
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT id, out_deg, y AS x, done OR (SELECT max(abs(y - x)) < {_MOVE} FROM b{i}) AS done FROM b{i})")
    return f"WITH {', '.join(ctes)} SELECT id, round(x, 6) AS rank FROM n{steps}"


ORACLES: dict[str, str] = {
    "host_graph": f"WITH e AS (SELECT src, dst, CASE WHEN l_linenumber > 1 THEN l_linenumber ELSE 1 END AS weight, CASE WHEN l_linenumber > 2 THEN l_orderkey % 5 ELSE 1 END AS cost FROM ({_LINES})), {_WHOLE} SELECT id, count(src)::BIGINT AS edges, coalesce(sum(weight), 0)::BIGINT AS weight, coalesce(sum(cost), 0)::BIGINT AS cost FROM v LEFT JOIN e ON src = id GROUP BY 1",
    "graph_defaults": f"WITH e AS (SELECT src, dst, CASE WHEN l_linenumber > 1 THEN l_linenumber ELSE 1 END AS weight FROM ({_LINES})), {_WHOLE} SELECT id, CASE WHEN id = 0 THEN 0 ELSE 999999 END::BIGINT AS dist, coalesce(sum(weight), 0)::BIGINT AS weight FROM v LEFT JOIN e ON dst = id GROUP BY id",
    "results_sink": f"WITH {_PURCHASE}, {_NODES} SELECT id, out_deg FROM d",
    "cached_edges": f"SELECT o_custkey AS src, l_suppkey + {PART} AS dst, (l_orderkey * 16 + l_linenumber) % 7 AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "dropped_keys": _unrolled(_SUPPLY, _FAR, "(x + weight) & 4294967295", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x AS dist").replace("FROM d)", f"FROM d WHERE id < {PART} OR id % 3 > 0)"),
    "delta_ranks": _delta_sql(_RANK_STEPS),
    "improving_labels": _unrolled(_CLICKS, "id", "x", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x AS label"),
    "newly_discovered": _unrolled(
        _CLICKS, f"CASE WHEN id = 1 THEN 2147483649 ELSE {INF}::BIGINT END", "CASE WHEN (x & 2147483648) <> 0 THEN x + 1 ELSE 0 END",
        f"coalesce(arg_min(m, m & {LOW}) FILTER (WHERE m <> 0), 0)", f"CASE WHEN g = 0 THEN x & {LOW} WHEN x = {INF} THEN g ELSE x & {LOW} END", DEFAULT_STEPS,
        f"id, CASE WHEN (x & {LOW}) <> {INF} THEN (x & {LOW}) - 1 END AS depth",
    ),
    "vector_sums": f"WITH {_VECTORS} SELECT dst AS id, i::BIGINT AS i, round(sum(v[i + 1] * ((src + dst) % 5)), 3) AS x FROM e JOIN w ON src = id, range(16) r(i) GROUP BY 1, 2",
    "als_residual": "SELECT vec_id AS id, 0.0::DOUBLE AS residual FROM embeddings",
    "benchmark_table": "SELECT s_name AS dataset, greatest(s_suppkey, s_nationkey * 100)::DOUBLE AS c3l11, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END::DOUBLE AS b2l444, NULL::DOUBLE AS b2l66, 2.5::DOUBLE AS b22l333, (s_suppkey % 7)::DOUBLE AS b3l433, NULL::DOUBLE AS b3l55, 4.0::DOUBLE AS b4l333 FROM supplier",
    "throughput_table": "SELECT c_name AS dataset, lower(c_mktsegment) AS algorithm, c_nationkey::VARCHAR AS throughput_mteps FROM customer WHERE c_nationkey % 4 <> 0",
}
