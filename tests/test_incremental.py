"""Edges that come and go: the state after each batch against a run from scratch on the edges that are left."""

import random

import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import PROGRAMS
from gasframe.operators.graph import Graph, converge
from gasframe.plans.superstep_plan import PlanError
from gasframe.streaming import incremental
from gasframe.streaming.incremental import Incremental

from .test_engine import program, values

FAR = "CASE WHEN id = 0 THEN 0L ELSE 999999L END"
EDGES = "eid long, src long, dst long, weight long"
MOST = PROGRAMS["wcc_self"]
NEGATIVE = program("x.src.p - x.w", "lambda a, b: a < b ? a : b", "lambda d: d < self.p ? d : self.p", node="p: int<64>", edge="w: int<64>")


def scratch(spark, text, prop, first, live, ids):
    nodes = spark.createDataFrame([(i,) for i in sorted(ids)], "id long").withColumn(prop, first)
    name = "w" if prop == "p" else "weight"
    edges = spark.createDataFrame([(k, *x) for k, x in live.items()], f"eid long, src long, dst long, {name} long")
    return values(converge(text, Graph(nodes, edges), 200).nodes, prop)


@pytest.mark.parametrize("text,prop,first", [(PROGRAMS["sssp"], "dist", FAR), (PROGRAMS["cc_self"], "label", "id"), (MOST, "label", "id"), (PROGRAMS["cc_bitmask"], "label", "shiftleft(1L, CAST(id % 30 AS INT))")], ids=["sssp", "least", "most", "bits"])
def test_added_and_deleted_edges(spark, text, prop, first):
    rng, first = random.Random(7), F.expr(first)
    live, ids, number = {}, set(), 0
    empty = Graph(spark.createDataFrame([(0,)], "id long").withColumn(prop, first), spark.createDataFrame([], EDGES))
    inc = Incremental(text, empty, first)
    for n in range(3):
        rows = []
        for _ in range((22, 4, 0)[n]):
            edge = (rng.randrange(9), rng.randrange(9), rng.randrange(0, 6))
            rows.append((number, *edge, None))
            number += 1
        gone = rng.sample(sorted(live), (0, 8, 6)[n])
        gone = [k for k in gone if k in live]
        rows += [(k, None, None, None, True) for k in [*gone, 10_000]]
        if n == 2:  # the number of a deleted edge used again
            rows.append((gone[0], 1, 2, 1, False))
        for k in gone:
            live.pop(k)
        live |= {r[0]: r[1:4] for r in rows if not r[4]}
        ids |= {x for r in rows if not r[4] for x in r[1:3]} | {0}
        batch = spark.createDataFrame(rows, EDGES + ", deleted boolean")
        inc.add(batch, n)
        want = scratch(spark, text, prop, first, live, ids)
        assert values(inc.nodes, prop) == want, n
        assert {r.eid: (r.src, r.dst, r.weight) for r in inc.edges.collect()} == live
    inc.add(batch, n)  # a replay changes nothing
    assert inc.batch == n and inc.edges.count() == len(live) and values(inc.nodes, prop) == want


def test_a_cycle_does_not_hold_itself_up(spark):
    """A label that has gone round a cycle goes when the edge by which it came goes."""
    edges = spark.createDataFrame([(0, 1, 2, 1), (1, 2, 3, 1), (2, 3, 2, 1), (3, 3, 4, 1)], EDGES)
    nodes = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "id long, label long")
    inc = Incremental(PROGRAMS["cc_self"], Graph(nodes, edges), F.col("id"))
    assert values(inc.nodes, "label") == {1: 1, 2: 1, 3: 1, 4: 1}
    inc.add(spark.createDataFrame([(0, True)], "eid long, deleted boolean").withColumns({c: F.lit(None).cast("long") for c in ("src", "dst", "weight")}))
    assert values(inc.nodes, "label") == {1: 1, 2: 2, 3: 2, 4: 2}


def test_messages_better_than_their_source(spark):
    """With negative weights an edge proves nothing; all nodes behind a deleted one start anew."""
    first = F.lit(100).cast("long")
    edges = spark.createDataFrame([(0, 0, 1, 5), (1, 1, 2, 3), (2, 0, 2, 1), (3, 2, 3, 2)], "eid long, src long, dst long, w long")
    inc = Incremental(NEGATIVE, Graph(spark.createDataFrame([(i, 100) for i in range(4)], "id long, p long"), edges), first)
    assert inc.better and values(inc.nodes, "p") == {0: 100, 1: 95, 2: 92, 3: 90}
    inc.add(spark.createDataFrame([(0, None, None, None, True)], "eid long, src long, dst long, w long, deleted boolean"))
    assert values(inc.nodes, "p") == {0: 100, 1: 100, 2: 97, 3: 95}


def test_a_driver_that_starts_again(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    batch = lambda *rows: spark.createDataFrame(rows, EDGES)
    empty = Graph(spark.createDataFrame([(0, 0)], "id long, dist long"), spark.createDataFrame([], EDGES))
    one = Incremental(PROGRAMS["sssp"], empty, F.expr(FAR), state=state)
    one.add(batch((0, 0, 1, 4), (1, 1, 2, 1)), 0)
    # A batch that breaks before its commit leaves the state as it was.
    monkeypatch.setattr(Incremental, "_commit", lambda self, n: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        one.add(batch((2, 0, 2, 1)), 1)
    monkeypatch.undo()
    two = Incremental(PROGRAMS["sssp"], None, F.expr(FAR), state=state, spark=spark)
    assert two.batch == 0 and values(two.nodes, "dist") == {0: 0, 1: 4, 2: 5} and two.edges.count() == 2
    two.add(batch((0, 0, 1, 4), (1, 1, 2, 1)), 0)
    two.add(batch((2, 0, 2, 1)), 1)
    assert values(two.nodes, "dist") == {0: 0, 1: 4, 2: 1} and two.edges.count() == 3
    monkeypatch.setattr(incremental, "MOST_PARTS", 1)
    two.add(spark.createDataFrame([(2, None, None, None, True), (3, 0, 3, 9, False)], EDGES + ", deleted boolean"), 2)
    three = Incremental(PROGRAMS["sssp"], None, F.expr(FAR), state=state, spark=spark)
    assert values(three.nodes, "dist") == {0: 0, 1: 4, 2: 5, 3: 9} and len(three.parts) == 1 and three.edges.count() == 3
    with pytest.raises(ValueError):
        Incremental(PROGRAMS["sssp"], None, F.expr(FAR), state=str(tmp_path / "none"), spark=spark)


def test_programs_that_cannot_be_kept(spark):
    g = Graph(spark.createDataFrame([(0, 0)], "id long, dist long"), spark.createDataFrame([], EDGES))
    negated = PROGRAMS["cc_self"].replace("e.src.label", "~e.src.label")
    for text in (PROGRAMS["sssp_inverted"], PROGRAMS["cc"], PROGRAMS["pagerank"], PROGRAMS["bits"], negated, PROGRAMS["cc_self"].replace("d < self.label", "d > self.label")):
        with pytest.raises(PlanError):
            Incremental(text, g, F.expr(FAR))
    incremental.checked(PROGRAMS["cc_self"].replace("d < self.label ? d : self.label", "self.label <= d ? self.label : d"))
