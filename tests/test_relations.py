"""Sets as relations against supersteps with arrays; and least squares in Arrow batches against numpy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import PROGRAMS
from gasframe.operators import normal, relations
from gasframe.operators.graph import Graph, gathered, iterate, scattered
from gasframe.plans.columns import Typed
from gasframe.plans.superstep_plan import PlanError, lower


def test_reachable_sets(spark):
    """A hub that all nodes lead to and that leads to all, a cycle, a loop, and elements that come twice."""
    rng = random.Random(4)
    links = [(i, 0) for i in range(1, 30, 3)] + [(0, i) for i in range(1, 30, 4)] + [(40, 41), (41, 42), (42, 40), (43, 43), (7, 40)] + [(rng.randrange(30), rng.randrange(50)) for _ in range(15)]
    nodes = spark.createDataFrame([(i, [i % 11, 100 + i % 3] if i % 2 else []) for i in range(50)] + [(60, None)], "id long, seen array<bigint>")
    g = Graph(nodes, spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "eid long, src long, dst long"))
    got = relations.united(PROGRAMS["reach"], g)
    want = {i: set(s or []) for i, s in ((r.id, r.seen) for r in nodes.collect())}
    new, counts = {i: set(s) for i, s in want.items()}, []
    while any(new.values()):
        sent = {i: set().union(*(new[a] for a, b in links if b == i)) for i in want}
        new = {i: sent[i] - want[i] for i in want}
        counts.append(sum(map(len, new.values())))
        want = {i: want[i] | new[i] for i in want}
    rows = [(r.id, r.element) for r in got.rows.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, x) for i, s in want.items() for x in s}
    assert list(got.new) == counts and got.steps == len(counts)
    few = {r.id: set(r.seen or []) for r in iterate(PROGRAMS["reach"], Graph(nodes.withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>"))), g.edges), 3).nodes.collect()}
    assert all(s <= want[i] for i, s in few.items())
    assert {r.id: r.seen for r in got.sets(nodes, "seen").collect()} == {i: sorted(s) for i, s in want.items()}
    assert relations.united(PROGRAMS["reach"], Graph(nodes.where("id = 60"), g.edges)).rows.count() == 0
    with pytest.raises(PlanError):
        relations.united(PROGRAMS["coloring"], g)
    with pytest.raises(Exception, match="still growing"):
        relations.united(PROGRAMS["reach"], g, 1)


def test_steps_of_unions_do_not_ask_again_which_nodes_there_are(spark, monkeypatch):
    plans, real = [], relations.written
    monkeypatch.setattr(relations, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    nodes = spark.createDataFrame([(0, [5]), (1, []), (2, [])], "id long, seen array<bigint>")
    links = lambda *pairs: Graph(nodes, spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "eid long, src long, dst long"))
    for known in ({}, {"closed": True}):
        assert {tuple(r) for r in relations.united(PROGRAMS["reach"], links((0, 1), (1, 2)), **known).rows.collect()} == {(0, 5), (1, 5), (2, 5)}
    assert plans and not any("LeftSemi" in p for p in plans)
    assert {tuple(r) for r in relations.united(PROGRAMS["reach"], links((0, 9), (9, 1), (0, 2))).rows.collect()} == {(0, 5), (2, 5)}


def test_normal_equations(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(40, 16))
    links = [(int(rng.integers(40)), int(d), float(rng.integers(5))) for d in rng.choice([1, 1, 1, 2, 5, 9], 500)]
    g = Graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>"), spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "eid long, src long, dst long, rating double").repartition(3))
    step = lower(PROGRAMS["als"])
    monkeypatch.setattr(normal, "_CHUNK", 64)
    sums, held = gathered(step, *scattered(step, g.nodes, g.edges))
    assert held.kind == "tuple" and [p[0] for p in held.parts] == ["matrix", "vector"]
    rows = {r.k: r.g for r in sums.collect()}
    assert set(rows) == {d for _, d, _ in links}
    for d, got in rows.items():
        own = [(vecs[s], w) for s, x, w in links if x == d]
        assert got._0.rows == got._0.cols == 16 and np.allclose(np.reshape(got._0.data, (16, 16)), sum(np.outer(v, v) for v, _ in own))
        assert np.allclose(got._1, sum(v * w for v, w in own))


def test_products_of_two_vectors(spark):
    """Factors that differ, vectors of other lengths and nulls."""
    kind = "struct<u:array<double>,w:array<double>>"
    rows = [(1, ([1.0, 2.0], [3.0, 4.0, 5.0])), (1, ([1.0], [1.0, 1.0, 1.0, 9.0])), (2, (None, [1.0, 2.0, 3.0])), (1, ([None, 1.0], [2.0, 0.0, 0.0]))]
    df = spark.createDataFrame(rows, f"k long, v {kind}").coalesce(1)
    sums, held = normal.normal_sums(df, Typed(F.col("v"), "outer", (), (2, 3)))
    assert held.kind == "matrix" and held.size == (2, 3)
    assert {r.k: (r.g.rows, r.g.cols, r.g.data) for r in sums.collect()} == {1: (2, 3, [4.0, 5.0, 6.0, 8.0, 8.0, 10.0]), 2: (2, 3, [0.0] * 6)}
    scaled, _ = normal.normal_sums(spark.createDataFrame([(1, ([1.0, 2.0], 2.0)), (1, ([0.5, 1.0], None))], "k long, v struct<u:array<double>,w:double>"), Typed(F.col("v"), "scaled", (), (2,)))
    assert [tuple(r) for r in scaled.collect()] == [(1, [2.0, 4.0])]
    assert normal._vectors(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1), 2).tolist() == [[3.0, 4.0]]
