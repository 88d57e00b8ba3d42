"""The graph queries: built-in programs and graph operators on graphs derived from the supplied tables, with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gasframe.algorithms import FIXED_STEPS, INF, LOW, PROGRAMS, bfs_depth, pagerank_fixed_point
from gasframe.operators import relations, statistics
from gasframe.operators.graph import DEFAULT_STEPS, Graph, compare, gathered, iterate, run, scattered
from gasframe.plans.dsl import parse
from gasframe.plans.superstep_plan import lower
from gasframe.sources import graphs
from gasframe.sources.generate import generate_graph
from gasframe.sources.scratch import shared_dir, written

PART = 1_000_000
MASK = 0xFFFFFFFF


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(pairs: DataFrame) -> DataFrame:
    """``pairs`` with an edge number that depends on the pair only."""
    return pairs.withColumn("eid", F.col("src") * 4 * PART + F.col("dst"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and the parts they sold, both ways, with small weights. The pairs are written once, in ranges of parts, so
    that what is counted by part is counted where it lies; the other way, numbers and weights are made of them as they
    are read."""
    sold = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"))
    one = written(sold.repartitionByRange("dst", "src").distinct(), "supply")
    both = one.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    edges = _numbered(both).withColumn("weight", 1 + (F.col("src") + F.col("dst")) % 9)
    return Graph(_ends(one), edges)


def purchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and the suppliers they bought from: bipartite, one way, with parallel edges."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    edges = written(o.join(li, o.o_orderkey == li.l_orderkey).select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("eid"), F.col("o_custkey").alias("src"), (F.col("l_suppkey") + PART).alias("dst")), "purchase")
    return Graph(_ends(edges), edges)


def clickflow(spark: SparkSession, sf_dir: str) -> Graph:
    """Users by whose event the next event of the hour came; parallel edges and loops. Events are put in order second by
    second; the last of a second is joined with the first of the next second of the hour that has any."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_trunc("second", "ts").alias("s"))
    w = Window.partitionBy("s").orderBy("ts", "event_id")
    inside = e.select("event_id", "user_id", "s", F.lead("user_id").over(w).alias("next"), F.lead("event_id").over(w).isNull().alias("last"))
    firsts = e.groupBy("s").agg(F.min(F.struct("ts", "event_id", "user_id"))["user_id"].alias("user_id"))
    after = firsts.select("s", F.lead("user_id").over(Window.partitionBy(F.date_trunc("hour", "s")).orderBy("s")).alias("after"))
    dst = F.when(F.col("last"), F.col("after")).otherwise(F.col("next"))
    edges = written(inside.join(after, "s").select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), dst.alias("dst")).where("dst IS NOT NULL"), "clickflow")
    return Graph(_ends(edges), edges)


def _with_degree(g: Graph) -> Graph:
    d = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    nodes = g.nodes.join(d, "id", "left").withColumn("out_deg", F.greatest(F.coalesce("d", F.lit(0)), F.lit(1)).cast("bigint")).drop("d")
    return Graph(nodes, g.edges)


def _start(g: Graph, **props) -> Graph:
    return Graph(g.nodes.withColumns(props), g.edges)


def _long(v: int):
    return F.lit(v).cast("bigint")


def _runner(graph: Callable, program: str, prop: str, steps: int | None, first: Callable, degree: bool = False, finish: Callable | None = None, no_message: object = "current") -> Callable:
    """A query that runs a program: exactly ``steps`` supersteps, or to the fixpoint, for which there are
    ``DEFAULT_STEPS``."""

    def started(g: Graph) -> Graph:
        return _start(_with_degree(g) if degree else g, **{prop: first()})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = run(PROGRAMS[program], started(graph(spark, sf_dir)), steps, no_message).nodes
        return finish(nodes) if finish else nodes.select("id", prop)

    query.graph, query.started, query.steps = graph, started, lambda g: run(PROGRAMS[program], g, steps, no_message)
    return query


def _far_from_zero():
    return F.when(F.col("id") == 0, _long(0)).otherwise(_long(999999))


def _ratings(spark: SparkSession, sf_dir: str) -> Graph:
    """Vectors of 16 floats, each the sums of all embedding values sixteen places apart; each is linked from five
    others, with ratings from ids."""
    whole = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(F.filter(F.col("embedding"), lambda x, j: j % 16 == i), F.lit(0.0), lambda a, x: a + x.cast("double")))
    v = written(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole.alias("vec")), "vectors")
    n = v.agg(F.count("*").alias("n"))
    pairs = v.select(F.col("id").alias("dst")).join(F.broadcast(n)).select(F.explode(F.array(*(((F.col("dst") * 7 + 13 * j + 1) % F.col("n")) for j in range(1, 6)))).alias("src"), "dst")
    return Graph(v, _numbered(pairs).withColumn("rating", ((F.col("src") + F.col("dst")) % 5).cast("double")))


def _als(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four least-squares steps."""
    out = iterate(PROGRAMS["als"], _ratings(spark, sf_dir), 4).nodes
    return out.select("id", F.transform("vec", lambda x: F.round(x, 3)).alias("vec"))


def _als_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a least-squares step gathers before it solves: traces and sums of each node's matrix, and its right side."""
    g, step = _ratings(spark, sf_dir), lower(PROGRAMS["als"])
    sums, _ = gathered(step, *scattered(step, g.nodes, g.edges))
    m, r = F.col("g._0.data"), F.col("g._1")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return sums.select(F.col("k").alias("id"), F.round(total(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(m, i * 17))), 4).alias("trace"), F.round(total(m), 4).alias("matrix_sum"), F.round(total(r), 4).alias("right_sum"))


def _filtered(g: Callable) -> Callable:
    return lambda spark, sf_dir: (lambda x: Graph(x.nodes, x.edges.withColumns({"p1": F.col("src"), "p2": F.col("dst")})))(g(spark, sf_dir))


def _average_degree(spark: SparkSession, sf_dir: str) -> Graph:
    """The purchase graph, each node with the average out-degree."""
    g = purchase(spark, sf_dir)
    average = g.edges.agg(F.count("*").alias("e")).crossJoin(g.nodes.agg(F.count("*").alias("v"))).select(F.expr("e div v").alias("avg_out_deg"))
    return Graph(g.nodes.join(F.broadcast(average)), g.edges)


def _differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose distance after two steps is not yet that of the fixpoint, with both."""
    g = _start(supply(spark, sf_dir), dist=_far_from_zero())
    return compare(iterate(PROGRAMS["sssp"], g, 2).nodes, run(PROGRAMS["sssp"], g).nodes, "dist")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from nations to regions, numbered from one, with the lengths of the nations' names as weights."""
    n = _table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("eid"), (F.col("n_nationkey") + 1).cast("bigint").alias("src"), (F.col("n_regionkey") + 1).cast("bigint").alias("dst"), F.length("n_name").cast("bigint").alias("weight"))


def _round_trip(kind: str) -> Callable:
    """Edges written to a graph file and read back: an edge list of all purchases, or nations and regions in the
    formats of one document."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}.{kind}"
        if kind == "txt":
            purchase(spark, sf_dir).edges.select(F.concat_ws(" ", "src", "dst", F.col("eid") % 7).alias("value")).write.text(path)
            return graphs.read_edges(spark, path).select("src", "dst", "weight")
        e = _nations(spark, sf_dir)
        if kind == "json":
            nodes = _ends(e).withColumn("dist", _long(0))
            graphs.write_graph_json(Graph(nodes, e), path)
            return graphs.read_json_graph(spark, path, parse(PROGRAMS["sssp"])).edges.select("src", "dst", "weight")
        if kind == "mtx":
            head = spark.range(1).select(F.lit("%%MatrixMarket matrix coordinate integer general").alias("value"), F.lit(-2).cast("bigint").alias("at"))
            size = e.agg(F.concat_ws(" ", F.max("src"), F.max("dst"), F.count("*")).alias("value"), F.lit(-1).cast("bigint").alias("at"))
            lines = head.union(size).union(e.select(F.concat_ws(" ", "src", "dst", "weight"), "eid"))
            lines.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
            return graphs.read_edges(spark, path).select("src", "dst", "weight")
        raise ValueError(kind)

    return query


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.statistics(purchase(spark, sf_dir))
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in s.dtypes))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.partition_plan(supply(spark, sf_dir), 4, 2, sparse_cap=200, dense_cap=50)


def _naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.naive_plan(supply(spark, sf_dir), 4, 2, sparse_cap=200, dense_cap=50)


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths on a random graph with as many nodes as there are customers."""
    n = _table(spark, sf_dir, "customer").count()
    return run(PROGRAMS["sssp"], generate_graph(spark, "sssp", n, 8 * n)).nodes.select("id", "dist")


def _territory(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions lead to nations, nations to their customers and suppliers, and these to what they ordered or sold; every
    region and nation is an element of its own set at first. Ids of one kind of row are those of its key, times six, plus
    the kind."""
    t = lambda name: _table(spark, sf_dir, name)
    at = lambda c, kind: (F.col(c).cast("bigint") * 6 + kind)
    link = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    pairs = link(t("nation"), at("n_regionkey", 0), at("n_nationkey", 1)).union(link(t("customer"), at("c_nationkey", 1), at("c_custkey", 2))).union(link(t("supplier"), at("s_nationkey", 1), at("s_suppkey", 3)))
    pairs = pairs.union(link(t("orders"), at("o_custkey", 2), at("o_orderkey", 4))).union(link(t("lineitem"), at("l_suppkey", 3), at("l_partkey", 5)).distinct())
    edges = written(pairs, "territory").withColumn("eid", F.monotonically_increasing_id())
    own = F.when(F.col("id") % 6 < 2, F.array("id")).otherwise(F.array().cast("array<bigint>"))
    return Graph(_ends(edges).withColumn("seen", own), edges)


def _reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions and nations from which a node can be reached."""
    return relations.united(PROGRAMS["reach"], _territory(spark, sf_dir), closed=True).rows


#: Programs with a step number make exactly so many supersteps: those of the rank families (``FIXED_STEPS``), and those that do
#: not settle. The others run to the fixpoint, or for ``DEFAULT_STEPS``; their SQL makes all of these.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sssp_weighted": _runner(supply, "sssp", "dist", None, _far_from_zero),
    "sssp_unweighted": _runner(supply, "sssp_unweighted", "dist", None, _far_from_zero),
    "sssp_inverted": _runner(supply, "sssp_inverted", "dist", 2, _far_from_zero),
    "bfs": _runner(supply, "bfs", "prop", None, lambda: F.when(F.col("id") == 0, _long((1 << 31) + 1)).otherwise(_long(INF)), finish=bfs_depth),
    "pagerank": _runner(clickflow, "pagerank", "rank", FIXED_STEPS["pagerank"], lambda: F.lit(1.0), degree=True, finish=lambda n: n.select("id", F.round("rank", 6).alias("rank"))),
    "article_rank": _runner(clickflow, "ar", "score", FIXED_STEPS["ar"], lambda: _long(0), degree=True),
    "article_rank_host": _runner(purchase, "ar", "score", FIXED_STEPS["ar"], lambda: F.col("id") % 97, degree=True, no_message="skip"),
    "connected_components": _runner(clickflow, "cc", "label", None, lambda: F.col("id")),
    "connected_components_self": _runner(supply, "cc_self", "label", None, lambda: F.col("id")),
    "wcc": _runner(clickflow, "wcc", "label", None, lambda: F.when(F.col("id") == 0, _long(1)).otherwise(_long(0))),
    "wcc_self": _runner(supply, "wcc_self", "label", None, lambda: F.col("id")),
    "cc_bitmask": _runner(clickflow, "cc_bitmask", "label", None, lambda: F.expr("shiftleft(1L, CAST(id % 30 AS INT))")),
    "graph_coloring": _runner(clickflow, "coloring", "color", 8, lambda: F.col("id")),
    "sssp_light_edges": _runner(supply, "sssp_light", "dist", None, _far_from_zero),
    "sssp_extra_properties": _runner(_filtered(supply), "sssp_extra", "dist", None, _far_from_zero),
    "sssp_fixed_point": _runner(supply, "sssp_fixed", "dist", None, lambda: F.when(F.col("id") == 0, F.lit(0.0)).otherwise(F.lit(999999.0))),
    "sssp_8_bit": _runner(supply, "sssp_8bit", "dist", None, lambda: F.when(F.col("id") == 0, _long(0)).otherwise(_long(255))),
    "article_rank_average": _runner(_average_degree, "ar_average", "score", FIXED_STEPS["ar"], lambda: _long(0), degree=True),
    "edge_order_difference": _runner(purchase, "difference", "label", 1, lambda: F.col("id")),
    "bit_operators": _runner(clickflow, "bits", "label", 3, lambda: F.col("id")),
    "least_gap_with_own": _runner(clickflow, "own_gap", "color", 3, lambda: F.col("id") % 11),
    "unfinished_nodes": _differing,
    "edges_from_json": _round_trip("json"),
    "edges_from_txt": _round_trip("txt"),
    "edges_from_mtx": _round_trip("mtx"),
    "als_step": _als,
    "als_sums": _als_sums,
    "degrees": lambda spark, sf_dir: statistics.degrees(purchase(spark, sf_dir)),
    "graph_statistics": _statistics,
    "in_degrees_descending": lambda spark, sf_dir: statistics.in_degrees_descending(purchase(spark, sf_dir)),
    "partition_plan": _plan,
    "naive_plan": _naive,
    "partition_loads": lambda spark, sf_dir: statistics.partition_loads(_plan(spark, sf_dir)),
    "pagerank_fixed_point": lambda spark, sf_dir: pagerank_fixed_point(clickflow(spark, sf_dir), FIXED_STEPS["pagerank"], tolerance=0),
    "generated_sssp": _generated,
    "reachable_sets": _reachable,
}

_SUPPLY = f"one AS (SELECT DISTINCT l_suppkey AS s, l_partkey + {PART} AS p FROM lineitem), e AS MATERIALIZED (SELECT src, dst, 1 + (src + dst) % 9 AS weight FROM (SELECT s AS src, p AS dst FROM one UNION ALL SELECT p, s FROM one))"
_PURCHASE = f"e AS MATERIALIZED (SELECT o_custkey AS src, l_suppkey + {PART} AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_CLICKS = "c AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events), e AS MATERIALIZED (SELECT src, dst FROM c WHERE dst IS NOT NULL)"
_NODES = "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), d AS (SELECT id, greatest(coalesce(n, 0), 1) AS out_deg FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) ON id = src)"


def _unrolled(graph: str, first: str, value: str, reduce: str, apply: str, steps: int, last: str) -> str:
    """SQL of ``steps`` supersteps: x is the property, g the gathered value, m the message, w an edge's weight."""
    ctes = [graph, _NODES, f"n0 AS MATERIALIZED (SELECT id, out_deg, {first} AS x FROM d)"]
    for i in range(steps):
        ctes.append(f"a{i} AS (SELECT dst, {reduce} AS g0 FROM (SELECT e.*, {value} AS m FROM e JOIN n{i} ON src = id) GROUP BY dst)")
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT id, out_deg, {apply} AS x FROM (SELECT n{i}.*, dst, CASE WHEN dst IS NULL THEN x ELSE g0 END AS g FROM n{i} LEFT JOIN a{i} ON id = dst))")
    return f"WITH {', '.join(ctes)} SELECT {last} FROM n{steps}"


_FAR = "CASE WHEN id = 0 THEN 0::BIGINT ELSE 999999::BIGINT END"
_STATS = "{c}_r AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n, sum({c}) OVER () AS s FROM dd)"


def _stats_side(c: str) -> str:
    return f"""(SELECT max(v) FROM {c}_r)::BIGINT AS max_{c},
  round((SELECT count(*) FILTER (WHERE v > 0) / count(*) FROM {c}_r), 6) AS active_{c},
  round((SELECT sqrt(greatest(sum(v * v) / max(n) - (sum(v) / max(n)) * (sum(v) / max(n)), 0)) / (sum(v) / max(n)) FROM {c}_r), 6) AS cv_{c},
  (SELECT min(v) FROM {c}_r WHERE i = floor((n - 1) * 0.9 + 0.5) + 1)::BIGINT AS p90_{c},
  (SELECT min(v) FROM {c}_r WHERE i = floor((n - 1) * 0.99 + 0.5) + 1)::BIGINT AS p99_{c},
  round((SELECT coalesce(sum(v), 0) / max(s) FROM {c}_r WHERE i > n - greatest(1, ceil(n * 0.01))), 6) AS top1pct_{c},
  round((SELECT coalesce(sum(v), 0) / max(s) FROM {c}_r WHERE i > n - greatest(1, ceil(n * 0.001))), 6) AS top01pct_{c},
  round((SELECT greatest(2 * sum(i * v) / (max(n) * max(s)) - (max(n) + 1) / max(n), 0) FROM {c}_r), 6) AS gini_{c}"""


_DEGREES = f"WITH {_PURCHASE}, {_NODES}, dd AS (SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM v LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY 1) ON id = dst LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY 1) ON id = src)"


def _dealt(dense: str) -> str:
    return f"""WITH {_SUPPLY}, dg AS (SELECT dst AS id, count(*) AS d FROM e GROUP BY 1),
r AS (SELECT id, d, row_number() OVER (ORDER BY d DESC, id) - 1 AS rk, coalesce(sum(d) OVER (ORDER BY d DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(d) OVER () AS total, count(*) OVER () AS n FROM dg),
m AS (SELECT *, {dense} AS is_dense FROM r), h AS (SELECT *, CASE WHEN is_dense THEN rk ELSE rk - count(*) FILTER (WHERE is_dense) OVER () END AS own, CASE WHEN is_dense THEN 2 ELSE 4 END AS g, CASE WHEN is_dense THEN 50 ELSE 200 END AS cap FROM m),
p AS (SELECT id, d::BIGINT AS in_degree, is_dense, (own % g)::BIGINT AS group_id, ((own // g) // cap)::BIGINT AS partition_id FROM h)"""


_CUT = f"before < total * {2 * 1_040_000 / (2 * 1_040_000 + 4 * 280_000)!r}"
ORACLES: dict[str, str] = {
    "sssp_weighted": _unrolled(_SUPPLY, _FAR, f"(x + weight) & {MASK}", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x AS dist"),
    "sssp_unweighted": _unrolled(_SUPPLY, _FAR, "x + 1", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x AS dist"),
    "sssp_inverted": _unrolled(_SUPPLY, _FAR, f"(x + weight) & {MASK}", "min(m)", "greatest(x, g)", 2, "id, x AS dist"),
    "bfs": _unrolled(
        _SUPPLY, f"CASE WHEN id = 0 THEN 2147483649 ELSE {INF}::BIGINT END", "CASE WHEN (x & 2147483648) <> 0 THEN x + 1 ELSE 0 END",
        f"coalesce(arg_min(m, m & {LOW}) FILTER (WHERE m <> 0), 0)", f"CASE WHEN g = 0 THEN x & {LOW} WHEN x = {INF} THEN g ELSE x & {LOW} END", DEFAULT_STEPS,
        f"id, CASE WHEN (x & {LOW}) <> {INF} THEN (x & {LOW}) - 1 END AS depth",
    ),
    "pagerank": _unrolled(_CLICKS, "1.0::DOUBLE", "x", "sum(m)", "0.15::DOUBLE + 0.85::DOUBLE * (g / out_deg)", FIXED_STEPS["pagerank"], "id, round(x, 6) AS rank"),
    "article_rank": _unrolled(_CLICKS, "0::BIGINT", "x", f"(sum(m)::BIGINT) & {MASK}", f"(((108 * g + 1258291) & {MASK}) * (65536 // out_deg)) & {MASK}", FIXED_STEPS["ar"], "id, x AS score"),
    "article_rank_host": _unrolled(_PURCHASE, "id % 97", "x", f"(sum(m)::BIGINT) & {MASK}", f"CASE WHEN dst IS NULL THEN x ELSE (((108 * g + 1258291) & {MASK}) * (65536 // out_deg)) & {MASK} END", FIXED_STEPS["ar"], "id, x AS score"),
    "connected_components": _unrolled(_CLICKS, "id", "x", "min(m)", "g", DEFAULT_STEPS, "id, x AS label"),
    "connected_components_self": _unrolled(_SUPPLY, "id", "x", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x AS label"),
    "wcc": _unrolled(_CLICKS, "CASE WHEN id = 0 THEN 1::BIGINT ELSE 0::BIGINT END", "x", "max(m)", "g", DEFAULT_STEPS, "id, x AS label"),
    "wcc_self": _unrolled(_SUPPLY, "id", "x", "max(m)", "greatest(x, g)", DEFAULT_STEPS, "id, x AS label"),
    "cc_bitmask": _unrolled(_CLICKS, "1::BIGINT << (id % 30)", "x", "bit_or(m)", "x | g", DEFAULT_STEPS, "id, x AS label"),
    "sssp_light_edges": _unrolled(_SUPPLY, _FAR, f"CASE WHEN weight <= 6 AND weight <> 3 THEN (x + weight) & {MASK} END", "min(m)", "least(x, coalesce(g, x))", DEFAULT_STEPS, "id, x AS dist"),
    "sssp_extra_properties": _unrolled(_SUPPLY, _FAR, f"(x + weight) & {MASK}", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x AS dist"),
    "sssp_fixed_point": _unrolled(_SUPPLY, _FAR, f"(x + weight) & {MASK}", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x::DOUBLE AS dist"),
    "sssp_8_bit": _unrolled(_SUPPLY, "CASE WHEN id = 0 THEN 0::BIGINT ELSE 255::BIGINT END", "x + weight", "min(m)", "least(x, g)", DEFAULT_STEPS, "id, x AS dist"),
    "article_rank_average": _unrolled(_PURCHASE, "0::BIGINT", "x", f"(sum(m)::BIGINT) & {MASK}", f"(((108 * g + 1258291) & {MASK}) * (65536 // (out_deg + (SELECT count(*) FROM e) // (SELECT count(*) FROM v)))) & {MASK}", FIXED_STEPS["ar"], "id, x AS score"),
    "edge_order_difference": f"WITH e AS (SELECT l_orderkey * 16 + l_linenumber AS eid, o_custkey AS src, l_suppkey + {PART} AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), a AS (SELECT dst, (2 * arg_min(src, eid) - sum(src))::BIGINT & {MASK} AS g, count(*) AS n, any_value(src) AS s FROM e GROUP BY 1) SELECT id, CASE WHEN dst IS NULL THEN id WHEN n = 1 THEN s ELSE g END AS label FROM v LEFT JOIN a ON id = dst",
    "bit_operators": _unrolled(_CLICKS, "id", "xor(x, -1) & 1023", "max(m)", f"CASE WHEN g > 512 OR x = 0 THEN (g - x) & {MASK} ELSE x END", 3, "id, x AS label"),
    "edges_from_json": "SELECT (n_nationkey + 1)::BIGINT AS src, (n_regionkey + 1)::BIGINT AS dst, length(n_name) AS weight FROM nation",
    "edges_from_mtx": "SELECT n_nationkey::BIGINT AS src, n_regionkey::BIGINT AS dst, length(n_name) AS weight FROM nation",
    "edges_from_txt": f"SELECT o_custkey AS src, l_suppkey + {PART} AS dst, (l_orderkey * 16 + l_linenumber) % 7 AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "unfinished_nodes": f"WITH a AS ({_unrolled(_SUPPLY, _FAR, f'(x + weight) & {MASK}', 'min(m)', 'least(x, g)', 2, 'id, x')}), b AS ({_unrolled(_SUPPLY, _FAR, f'(x + weight) & {MASK}', 'min(m)', 'least(x, g)', DEFAULT_STEPS, 'id, x')}) SELECT id, b.x AS expected, a.x AS actual FROM a JOIN b USING (id) WHERE a.x <> b.x",
    "degrees": f"{_DEGREES} SELECT id, in_degree::BIGINT AS in_degree, out_degree::BIGINT AS out_degree FROM dd",
    "graph_statistics": f"{_DEGREES}, {_STATS.format(c='in_degree')}, {_STATS.format(c='out_degree')} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / (SELECT count(*) FROM v), 6) AS avg_degree, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) AS density, {_stats_side('in_degree')}, {_stats_side('out_degree')}",
    "in_degrees_descending": f"{_DEGREES} SELECT id, in_degree::BIGINT AS in_degree FROM dd WHERE in_degree > 0",
    "partition_plan": f"{_dealt(_CUT)} SELECT * FROM p",
    "naive_plan": f"{_dealt('rk < ceil(n * 0.2)')} SELECT * FROM p",
    "partition_loads": f"{_dealt(_CUT)} SELECT is_dense, group_id, partition_id, count(*) AS destinations, sum(in_degree)::BIGINT AS edges FROM p GROUP BY ALL",
}


def _coloring_sql(steps: int, first: str = "id", held: str = "l") -> str:
    """A node without a message keeps its colour; others take the least number that no message holds."""
    ctes = [_CLICKS, _NODES, f"n0 AS MATERIALIZED (SELECT id, {first} AS x FROM d)"]
    for i in range(steps):
        ctes.append(f"a{i} AS (SELECT dst, list_distinct(list(x)) AS l FROM e JOIN n{i} ON src = id GROUP BY dst)")
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT id, CASE WHEN l IS NULL THEN x ELSE (list_filter(range(0, len({held}) + 1), lambda q: NOT list_contains({held}, q)))[1] END AS x FROM n{i} LEFT JOIN a{i} ON id = dst)")
    return f"WITH {', '.join(ctes)} SELECT id, x AS color FROM n{steps}"


ORACLES["graph_coloring"] = _coloring_sql(8)
ORACLES["least_gap_with_own"] = _coloring_sql(3, "id % 11", "list_append(l, x)")


def _fixed_point_sql(steps: int) -> str:
    ctes = [_CLICKS, _NODES, "k AS (SELECT count(*) AS n FROM v)", "o AS (SELECT id, n AS d FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) ON id = src)", "n0 AS MATERIALIZED (SELECT id, d, coalesce(((1 << 30) // k.n) // d, 0) AS c FROM o, k)"]
    for i in range(steps):
        ctes.append(f"a{i} AS (SELECT dst, sum(c)::BIGINT AS s FROM e JOIN n{i} ON src = id GROUP BY dst)")
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT id, d, CASE WHEN d IS NULL THEN 0 ELSE ((((1 << 30) * 15::BIGINT) // (100 * k.n) + ((coalesce(s, 0) * 108) >> 7)) * (65536 // d)) >> 16 END AS c FROM n{i} LEFT JOIN a{i} ON id = dst, k)")
    return f"WITH {', '.join(ctes)} SELECT id, c::BIGINT AS contribution FROM n{steps}"


ORACLES["pagerank_fixed_point"] = _fixed_point_sql(FIXED_STEPS["pagerank"])


def _als_sums_sql() -> str:
    """The trace of a sum of outer products is a sum of squares, and all its entries are a sum of squared sums."""
    return """WITH w AS (SELECT vec_id AS id, list_transform(range(1, 17), lambda i: list_sum(list_transform(range(0, len(embedding) // 16), lambda j: embedding[i + 16 * j]::DOUBLE))) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM w), e AS (SELECT (id * 7 + 13 * j + 1) % n AS src, id AS dst FROM w, n, range(1, 6) r(j))
SELECT dst AS id, round(sum(list_sum(list_transform(v, lambda x: x * x))), 4) AS trace, round(sum(list_sum(v) * list_sum(v)), 4) AS matrix_sum, round(sum(list_sum(v) * ((src + dst) % 5)), 4) AS right_sum FROM e JOIN w ON src = id GROUP BY 1"""


ORACLES["als_sums"] = _als_sums_sql()
ORACLES["reachable_sets"] = """WITH RECURSIVE e AS (SELECT n_regionkey * 6 AS src, n_nationkey * 6 + 1 AS dst FROM nation UNION SELECT c_nationkey * 6 + 1, c_custkey * 6 + 2 FROM customer UNION SELECT s_nationkey * 6 + 1, s_suppkey * 6 + 3 FROM supplier
UNION SELECT o_custkey * 6 + 2, o_orderkey * 6 + 4 FROM orders UNION SELECT l_suppkey * 6 + 3, l_partkey * 6 + 5 FROM lineitem),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id, id AS element FROM v WHERE id % 6 < 2 UNION SELECT e.dst, r.element FROM r JOIN e ON e.src = r.id)
SELECT id::BIGINT AS id, element::BIGINT AS element FROM r"""
