import json

import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import PROGRAMS
from gasframe.operators import statistics
from gasframe.operators.graph import Graph, converge, iterate
from gasframe.plans.dsl import parse
from gasframe.sources import graphs
from gasframe.sources.generate import APPS, GenerateError, generate_graph


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_edge_list(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("# comment\n\n% other\n0 1 5\n1 2\n2 0 3.5\nx y\n7\n 3\t4  8 \n")
    assert rows(graphs.read_edges(spark, str(p)).orderBy("eid").drop("eid")) == [(0, 1, 5), (1, 2, None), (2, 0, None), (3, 4, 8)]


@pytest.mark.parametrize("text,expected", [
    ("%%MatrixMarket matrix coordinate pattern general\n% note\n3 3 2\n1 2 9\n2 3 9\n", [(0, 1, None), (1, 2, None)]),
    ("%%MatrixMarket matrix coordinate real general\n3 3 2\n1 2 2.9\n2 3 4\n", [(0, 1, 2), (1, 2, 4)]),
    ("3 3 2\n1 2 7\n", [(2, 2, 2), (0, 1, 7)]),
])
def test_matrix_market(spark, tmp_path, text, expected):
    p = tmp_path / "g.mtx"
    p.write_text(text)
    assert rows(graphs.read_edges(spark, str(p)).orderBy("eid").drop("eid")) == expected


def test_read_graph(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("0 1 3\n1 2 1\n")
    g = graphs.read_graph(spark, str(p), "sssp")
    assert rows(g.nodes.orderBy("id")) == [(0, 0), (1, 999999), (2, 999999)]
    assert {r.id: r.dist for r in converge(PROGRAMS["sssp"], g, 8).nodes.collect()} == {0: 0, 1: 3, 2: 4}
    (tmp_path / "one.txt").write_text("1 2\n2 5\n-1 3\n")
    dense = graphs.read_graph(spark, str(tmp_path / "one.txt"), "cc", dense_ids=True)
    assert sorted(r.id for r in dense.nodes.collect()) == [0, 1, 2, 3, 4]
    (tmp_path / "none.txt").write_text("# nothing\n")
    with pytest.raises(graphs.EmptyGraph):
        graphs.read_graph(spark, str(tmp_path / "none.txt"), "cc")
    with pytest.raises(graphs.UnsupportedFormat):
        graphs.read_graph(spark, str(tmp_path / "g.xyz"), "cc")


def test_json_defaults_and_round_trip(spark, tmp_path):
    program = parse("{ Node: { a: int<8> f: float b: bool v: vector<float, 3> s: set<int<8>> } Edge: { w: int<8> } } { return x as result_node_prop.a }")
    doc = {"nodes": [{"id": 1, "properties": {"a": 5}}, {"id": 1, "properties": {"a": 9, "f": "x", "b": True, "v": [1, 2, 3, 4], "s": [3, 1, 3], "extra": 1}}, {"id": 2, "properties": {}}], "edges": [{"src": 1, "dst": 2, "properties": {"w": 4}}, {"src": 2, "dst": 2, "properties": {}}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc))
    g = graphs.read_json_graph(spark, str(p), program)
    assert rows(g.nodes.orderBy("id")) == [(1, 9, 0.0, True, [1.0, 2.0, 3.0], [1, 3]), (2, 0, 0.0, False, [0.0, 0.0, 0.0], [])]
    assert rows(g.edges.orderBy("eid")) == [(0, 1, 2, 4), (1, 2, 2, 0)]
    graphs.write_graph_json(g, str(tmp_path / "out"))
    again = graphs.read_json_graph(spark, str(tmp_path / "out"), program)
    assert sorted(rows(again.nodes)) == sorted(rows(g.nodes)) and rows(again.edges.orderBy("eid")) == rows(g.edges.orderBy("eid"))
    graphs.write_graph_parquet(g, str(tmp_path / "pq"))
    assert graphs.read_graph_parquet(spark, str(tmp_path / "pq")).edges.count() == 2
    assert rows(graphs.results(g.nodes, "v"))[0] == (1, "[1.0,2.0,3.0]")


@pytest.mark.parametrize("app", APPS)
def test_generate(spark, app):
    g, h = (generate_graph(spark, app, 40, 300, 7) for _ in range(2))
    assert sorted(rows(g.edges)) == sorted(rows(h.edges)) and sorted(rows(g.nodes)) == sorted(rows(h.nodes))
    assert g.edges.select("src", "dst").distinct().count() == 300 and g.nodes.count() == 40
    assert g.edges.where("src < 0 OR src >= 40 OR dst < 0 OR dst >= 40").count() == 0
    if app in ("pagerank", "ar"):
        assert g.nodes.agg(F.min("out_deg")).first()[0] >= 1
    if app == "bfs":
        assert g.nodes.where("id = 0").first().prop == 0x80000001


def test_many_ranges(spark, monkeypatch):
    """Ranges of sources share the edges out exactly, and far more nodes than 64 bits have pairs for can be planned."""
    from gasframe.sources import generate

    for leaves in (1, 3, 8):
        parts = [generate.leaf(5, 50, 700, leaves, k) for k in range(leaves)]
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(leaves)] and sum(p[1] for p in parts) == 50
        assert [p[3] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(leaves)] and sum(p[2] for p in parts) == 700
    monkeypatch.setattr(generate, "LEAF_EDGES", 40)
    g = generate_graph(spark, "cc", 50, 700, 5)
    e = sorted(rows(g.edges.select("src", "dst")))
    assert len(set(e)) == 700 and [(r.eid, r.src, r.dst) for r in g.edges.orderBy("eid").collect()] == [(k, *x) for k, x in enumerate(e)]
    density = [sum(generate.leaf(seed, 50, 700, 18, k)[2] for seed in range(12)) / generate.leaf(0, 50, 700, 18, k)[1] for k in range(18)]
    assert max(density) < 1.3 * min(density)
    big = generate.leaf(1, 10**10, 10**12, 4_000_000, 3_999_999)
    assert big[0] + big[1] == 10**10 and big[2] + big[3] == 10**12 and abs(big[2] - 250_000) < 5_000
    assert generate_graph(spark, "cc", 10**10, 10**12).edges._jdf.queryExecution().executedPlan() is not None
    assert len(set(generate._cells(__import__("numpy").random.default_rng(1), 1 << 61, 5000).tolist())) == 5000


def test_generate_limits(spark):
    assert generate_graph(spark, "cc", 5, 25).edges.count() == 25
    for args in (("zz", 3, 3), ("cc", 0, 3), ("cc", 3, 0), ("cc", 3, 10)):
        with pytest.raises(GenerateError):
            generate_graph(spark, *args)


def test_statistics_of_no_edges_and_missing_nodes(spark):
    n = spark.createDataFrame([(0,), (1,)], "id long")
    none = Graph(n, spark.createDataFrame([], "eid long, src long, dst long"))
    s = statistics.statistics(none).first()
    assert (s.nodes, s.edges, s.max_in_degree, s.gini_in_degree) == (2, 0, 0, 0.0)
    g = Graph(n, spark.createDataFrame([(0, 0, 5)], "eid long, src long, dst long"))
    assert [r.id for r in g.missing_nodes().collect()] == [5]
    assert iterate(PROGRAMS["cc_self"], Graph(n.withColumn("label", F.col("id")), g.edges), 1).nodes.count() == 2
    assert statistics.partition_plan(none, 1, 1).count() == 0
    with pytest.raises(ValueError):
        statistics.partition_plan(none, 0, 0)


def test_host_graph_with_properties(spark, tmp_path):
    from gasframe.sources.graphs import EmptyGraph, read_host_graph

    (tmp_path / "h.txt").write_text("# c\n1 2 5 7\n2 4\n-1 2 3\n4 1 x 9\n")
    g = read_host_graph(spark, str(tmp_path / "h.txt"), ("weight", "cost"))
    assert sorted((r.src, r.dst, r.weight, r.cost) for r in g.edges.collect()) == [(0, 1, 5, 7), (1, 3, 1, 1), (3, 0, 1, 9)] and g.nodes.count() == 4
    (tmp_path / "none.txt").write_text("# nothing\n")
    try:
        read_host_graph(spark, str(tmp_path / "none.txt"))
        raise AssertionError
    except EmptyGraph:
        pass


def test_results_as_one_object(spark, tmp_path):
    import json

    from gasframe.sources.graphs import write_results_json

    nodes = spark.createDataFrame([(10, 1.5, [1, 2]), (2, None, [])], "id long, rank double, held array<long>")
    for prop, want in (("rank", {"2": None, "10": 1.5}), ("held", {"2": [], "10": [1, 2]})):
        write_results_json(nodes, prop, str(tmp_path / prop))
        text = "".join(p.read_text() for p in (tmp_path / prop).glob("part-*"))
        assert json.loads(text) == want and list(json.loads(text)) == ["2", "10"]
