"""Steps in which only changed nodes send, against steps in which all do."""

import random

import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import INF, PROGRAMS
from gasframe.operators import frontier
from gasframe.operators.graph import Graph, iterate, run
from gasframe.plans.superstep_plan import lower

from .test_engine import program, values

FILTERED = program("x.src.p + x.w", "lambda a, b: a < b ? a : b", "lambda d: d > 60 ? self.p : d", before="f = filter([e], lambda x: x.src.p != 7 && x.w > 1)")
FLOATS = program("x.src.p * 0.5", "lambda a, b: a > b ? a : b", "lambda d: d > self.p ? d : self.p", node="p: float")
BITS = program("x.src.p & x.w", "lambda a, b: a | b", "lambda d: (d + 1) & 1023")
#: Program, property, and how far apart values may start.
CASES = {
    "sssp": (PROGRAMS["sssp"], "dist", 40), "cc": (PROGRAMS["cc"], "label", 40), "wcc_self": (PROGRAMS["wcc_self"], "label", 90), "cc_bitmask": (PROGRAMS["cc_bitmask"], "label", 60), "sssp_inverted": (PROGRAMS["sssp_inverted"], "dist", 9),
    "sssp_8bit": (PROGRAMS["sssp_8bit"], "dist", 255), "bits": (PROGRAMS["bits"], "label", 900), "filtered": (FILTERED, "p", 50), "floats": (FLOATS, "p", 50), "or": (BITS, "p", 1000),
}


def random_graph(spark, prop, kind, most, seed, nodes=60, edges=110):
    rng = random.Random(seed)
    n = [(3 * i, kind(rng.randrange(most))) for i in range(nodes)]
    e = [(i, 3 * rng.randrange(nodes), 3 * min(rng.randrange(nodes), rng.randrange(nodes)), rng.randrange(1, 9)) for i in range(edges)]
    name = "w" if prop == "p" else "weight"
    return Graph(spark.createDataFrame(n, f"id long, {prop} {'double' if kind is float else 'long'}"), spark.createDataFrame(e, f"eid long, src long, dst long, {name} long"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_as_all_sending(spark, name):
    text, prop, most = CASES[name]
    step = lower(text)
    g = random_graph(spark, prop, float if name == "floats" else int, most, 1 + len(name) % 2)
    assert frontier.suits(step, g.nodes.columns)
    got = frontier.settled(step, g, 6)
    assert values(got.nodes, prop) == values(iterate(text, g, got.steps).nodes, prop)
    assert got.steps == 6 or got.converged and len(got.messages) == got.steps


def test_messages_are_the_edges_of_changed_nodes(spark):
    g = random_graph(spark, "dist", lambda x: 0 if x == 7 else 999999, 40, 5, 200, 500)
    step = lower(PROGRAMS["sssp"])
    run_ = frontier.settled(step, g, 40)
    links = [(r.src, r.dst, r.weight) for r in g.edges.collect()]
    dist, want, moved = values(g.nodes, "dist"), [], set(values(g.nodes, "dist"))
    while moved:
        sent = [(b, dist[a] + w) for a, b, w in links if a in moved]
        want.append(len(sent))
        after = {i: min([v, *(x for b, x in sent if b == i)]) for i, v in dist.items()}
        moved, dist = {i for i in dist if after[i] != dist[i]}, after
    assert values(run_.nodes, "dist") == dist
    assert run_.converged and list(run_.messages) == want and want[-1] < 250


def test_breadth_first(spark):
    g = random_graph(spark, "prop", lambda x: (1 << 31) + 1 if x == 0 else INF, 40, 3, 80, 160)
    got = frontier.settled(lower(PROGRAMS["bfs"]), g, 30)
    assert got.converged and values(got.nodes, "prop") == values(iterate(PROGRAMS["bfs"], g, got.steps).nodes, "prop")
    degree = {r.src: r["count"] for r in g.edges.groupBy("src").count().collect()}
    active = [i for i, v in values(iterate(PROGRAMS["bfs"], g, 1).nodes, "prop").items() if v & 1 << 31]
    assert got.messages[1] == sum(degree.get(i, 0) for i in active)


def test_bucketed_edges_and_named_sources(spark, monkeypatch):
    g = random_graph(spark, "label", int, 300, 8, 150, 260)
    want = run(PROGRAMS["cc_self"], g)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = len(spark.catalog.listTables())
        for named in (0, 50):
            monkeypatch.setattr(frontier, "NAMED", named)
            got = run(PROGRAMS["cc_self"], g)
            assert values(got.nodes, "label") == values(want.nodes, "label") and got.messages == want.messages
        assert len(spark.catalog.listTables()) == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_what_does_not_suit(spark):
    assert not frontier.suits(lower(PROGRAMS["pagerank"]), ["rank", "out_deg"]) and not frontier.suits(lower(PROGRAMS["sssp"]), ["id"])
    assert not frontier.suits(lower(program("x.w", "lambda a, b: a < b ? a : b").replace("x.dst", "x.src.p")), ["p"])
    g = random_graph(spark, "dist", int, 40, 1)
    assert run(PROGRAMS["sssp"], Graph(g.nodes.where(F.col("id") < 0), g.edges)).converged
