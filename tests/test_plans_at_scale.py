"""Aggregates that hold no node's messages in one place, against the plain way."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import PROGRAMS
from gasframe.functions.linear import eliminated
from gasframe.operators import graph as engine
from gasframe.operators.graph import Graph, iterate
from gasframe.plans.superstep_plan import lower
from gasframe.sources.generate import generate_graph
from gasframe.sources.scratch import bucketed, forget, written


def test_least_gaps_in_blocks(spark):
    rng, n = random.Random(3), engine.GAP_BLOCK
    sets = {0: range(3 * n), 1: [*range(n), *range(n + 5, 2 * n)], 2: range(1, 9), 3: [-1, -n - 3, 0, 1], 4: [5 * n], 5: [*range(2 * n), *range(3 * n, 4 * n)], 6: [-4], 7: [rng.randint(-5, 40) for _ in range(200)]}
    rows = [(k, [x]) for k, xs in sets.items() for x in xs for _ in range(1 + k % 2)]
    got = {r.k: r.g for r in engine._gaps(spark.createDataFrame(rows, "k long, v array<long>")).collect()}
    assert got == {k: next(i for i in range(10 * n) if i not in set(xs)) for k, xs in sets.items()}


def test_gaps_are_sought_without_sets_only_where_nothing_else_is_asked():
    assert engine._least_gap(lower(PROGRAMS["coloring"])) and engine._least_gap(lower(PROGRAMS["own_gap"])) is None
    assert engine._least_gap(lower(PROGRAMS["cc"])) is None


def test_a_colour_is_the_least_gap_of_the_neighbours(spark):
    rng = random.Random(8)
    edges = [(i, rng.randint(0, 30), rng.randint(0, 30)) for i in range(200)]
    g = Graph(spark.createDataFrame([(i, i % 7, 0) for i in range(31)], "id long, color long, priority long"), spark.createDataFrame(edges, "eid long, src long, dst long"))
    want = {i: i % 7 for i in range(31)}
    for _ in range(3):
        seen = {i: {want[s] for _, s, d in edges if d == i} for i in want}
        want = {i: next(c for c in range(99) if c not in seen[i]) if seen[i] else want[i] for i in want}
    assert {r.id: r.color for r in iterate(PROGRAMS["coloring"], g, 3).nodes.collect()} == want


def test_sums_of_products_are_taken_without_matrices(spark):
    rng = np.random.default_rng(1)
    vecs, edges = rng.normal(size=(9, 16)), [(i, int(s), int(d), float(r)) for i, (s, d, r) in enumerate(zip(rng.integers(0, 9, 40), rng.integers(0, 9, 40), rng.normal(size=40)))]
    g = Graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>"), spark.createDataFrame(edges, "eid long, src long, dst long, rating double"))
    messages, value = engine.scattered(lower(PROGRAMS["als"]), g.nodes, g.edges)
    assert [p[0] for p in value.parts] == ["outer", "scaled"]
    got = {r.id: r.vec for r in iterate(PROGRAMS["als"], g, 1).nodes.collect()}
    for i in {d for _, _, d, _ in edges}:
        a = sum(np.outer(vecs[s], vecs[s]) for _, s, d, _ in edges if d == i) + 1e-6 * np.eye(16)
        b = sum(vecs[s] * r for _, s, d, r in edges if d == i)
        assert np.allclose(a @ np.array(got[i]), b, atol=1e-4)


def test_elimination_with_a_least_pivot():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 6, 6)), rng.normal(size=(50, 6))
    assert np.allclose(eliminated(a, b), np.linalg.solve(a, b[..., None])[..., 0])
    flat = np.array([[[1.0, 1.0], [1.0, 1.0]], [[0.0, 0.0], [0.0, 2.0]], [[0.0, 1.0], [1.0, 0.0]]])
    out = eliminated(flat, np.array([[2.0, 2.0], [0.0, 4.0], [3.0, 5.0]]))
    assert np.isfinite(out).all() and out[0].sum() == 2 and out[1].tolist() == [0.0, 2.0] and out[2].tolist() == [5.0, 3.0]


def test_systems_are_solved_a_stack_at_a_time(monkeypatch):
    import pandas as pd

    from gasframe.functions import linear

    held, real = [], linear.eliminated
    monkeypatch.setattr(linear, "eliminated", lambda a, b: held.append(len(a)) or real(a, b))
    rng, n = np.random.default_rng(4), 2500
    a, b = rng.normal(size=(n, 3, 3)), rng.normal(size=(n, 3))
    out = linear.solve_batch(pd.Series([3] * n), pd.Series([3] * n), pd.Series(list(a.reshape(n, 9))), pd.Series(list(b)))
    assert sum(held) == n and max(held) <= 1024 and all(x.base is None for x in out)
    assert np.allclose((a + 1e-6 * np.eye(3)) @ np.stack(out)[..., None], b[..., None], atol=1e-6)


def test_generated_graphs_have_exactly_their_edges(spark):
    for nodes, edges in ((7, 49), (7, 48), (100, 9000), (1000, 70_000), (3, 1)):
        e = generate_graph(spark, "cc", nodes, edges).edges
        assert e.count() == edges == e.select("src", "dst").distinct().count()
        assert e.where(f"src < 0 OR dst < 0 OR src >= {nodes} OR dst >= {nodes}").count() == 0


def test_bucketed_tables_are_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    t = bucketed(written(spark.range(9).select(F.col("id").alias("src")), "t"), "b", 3, "src")
    assert {x.name for x in spark.catalog.listTables()} != before
    forget(t)
    assert {x.name for x in spark.catalog.listTables()} == before


def test_supply_is_stored_one_way(spark):
    from gasframe.queries import PART, supply

    g = supply(spark, "/root/testdata/sf0.001")
    stored = spark.read.parquet(*g.edges.inputFiles())
    assert stored.columns == ["src", "dst"] and stored.where(F.col("dst") < PART).count() == 0 and 2 * stored.count() == g.edges.count()
    assert {r.id for r in g.nodes.collect()} == {r.src for r in g.edges.collect()}


@pytest.mark.parametrize("program", ["cc_self", "wcc_self"])
def test_edges_are_dealt_with_what_is_read(spark, monkeypatch, program):
    """Least and greatest labels need no edge numbers, and a difference does."""
    dealt, real = [], engine._dealt
    monkeypatch.setattr(engine, "_dealt", lambda edges: dealt.append(edges.columns) or real(edges))
    g = Graph(spark.createDataFrame([(i, i) for i in range(9)], "id long, label long"), spark.createDataFrame([(i, i, i + 1) for i in range(8)], "eid long, src long, dst long"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.id: r.label for r in engine.run(PROGRAMS[program], g).nodes.collect()} == {i: 0 if program == "cc_self" else i for i in range(9)}
        iterate(PROGRAMS["difference"], g, 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert dealt == [["src", "dst"], ["eid", "src", "dst"]]


def test_sources_with_near_ids_send_from_one_task(spark):
    """Four blocks of 40 nodes, each linked with all of its block: nodes get a message from one bucket, few from two."""
    links = [(40 * b + i, 40 * b + j) for b in range(4) for i in range(40) for j in range(40) if i != j]
    g = Graph(spark.createDataFrame([(i, i) for i in range(170)], "id long, label long"), spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(links)], "eid long, src long, dst long"))
    names = ("spark.sql.autoBroadcastJoinThreshold", engine.ALL_KEYS)
    old = [spark.conf.get(n) for n in names]
    try:
        for n, x in zip(names, ("-1", "true")):
            spark.conf.set(n, x)
        step = lower(PROGRAMS["wcc_self"])
        nodes, edges = engine._prepared(step, g, ordered=False)
        sent = engine.scattered(step, nodes, edges)[0].withColumn("task", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n")).collect()
        assert len(sent) == 160 and all(r.n == 39 for r in sent) and sum(r.tasks for r in sent) <= 160 + 3 * 40
        homes = [r[0] for r in edges.cold.select(f"`{engine.HOME}`").distinct().collect()]
        assert len(spark.createDataFrame([(h,) for h in homes], "h long").select(F.pmod(F.hash("h"), F.lit(4))).distinct().collect()) == len(homes) > 1
        assert nodes.where(F.col(f"`{engine.HOME}`").isNull()).count() == 10
        engine._put_away(edges)
        out = engine.run(PROGRAMS["wcc_self"], g)
        assert out.nodes.columns == ["id", "label"] and {r.id: r.label for r in out.nodes.collect()} == {i: i // 40 * 40 + 39 if i < 160 else i for i in range(170)}
        assert iterate(PROGRAMS["difference"], g, 2).nodes.columns == ["id", "label"] and spark.conf.get(engine.ALL_KEYS) == "true"
    finally:
        for n, x in zip(names, old):
            spark.conf.set(n, x)


def test_an_edge_property_may_be_called_home(spark):
    """The bucket key does not stand in the place of a property."""
    text = PROGRAMS["sssp"].replace("weight", "home")
    g = Graph(spark.createDataFrame([(i, 0 if i == 0 else 999) for i in range(30)], "id long, dist long"), spark.createDataFrame([(i, i, i + 1, 2 + i % 3) for i in range(29)], "eid long, src long, dst long, home long"))
    want = {r.id: r.dist for r in iterate(text, g, 4).nodes.collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.id: r.dist for r in iterate(text, g, 4).nodes.collect()} == want and want[4] == 2 + 3 + 4 + 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_supply_lies_in_ranges_of_parts(spark):
    from gasframe.queries import supply

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = spark.read.parquet(*supply(spark, "/root/testdata/sf0.01").edges.inputFiles()).withColumn("file", F.input_file_name())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files, parts, both = (stored.select(*c).distinct().count() for c in (["file"], ["dst"], ["file", "dst"]))
    assert files > 1 and both < parts + files


def test_the_rest_stands_where_the_training_data_part_cannot_be_imported(monkeypatch):
    import __spark_entry__

    from gasframe import queries, queries_more

    monkeypatch.setitem(sys.modules, "gasframe.llm.queries", None)
    assert set(__spark_entry__.queries()) == {*queries.QUERIES, *queries_more.QUERIES} and set(__spark_entry__.oracle_sql()) == {*queries.ORACLES, *queries_more.ORACLES}
