"""Documents read and written by many tasks, and running sums."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import PROGRAMS
from gasframe.operators.graph import Graph
from gasframe.operators.prefix import Ordered
from gasframe.plans.dsl import parse
from gasframe.sources import graphs
from gasframe.sources.documents import elements

PROGRAM = parse("{ Node: { a: int<8> v: vector<float, 2> } Edge: { w: int<8> } } { return x as result_node_prop.a }")


def document(rng, nodes=60, edges=90):
    odd = ['a } b', '{"x":[1', 'quote " and \\ }', "]}", "é}\n", ""]
    return {
        "nodes": [{"id": rng.randrange(40), "properties": {"a": rng.randrange(99), "v": [1, rng.random()], "note": rng.choice(odd)}} for _ in range(nodes)],
        "edges": [{"src": rng.randrange(40), "dst": rng.randrange(40), "properties": {"w": k, "deep": {"x": [{"y": rng.choice(odd)}]}}} for k in range(edges)],
    }


@pytest.mark.parametrize("indent", [None, 2, 0])
def test_reads_as_one_reader_does(spark, tmp_path, indent):
    doc = document(random.Random(indent or 1))
    if indent == 2:
        doc = {"name": "x } [", "empty": [], "size": 3, "edges": doc["edges"], "nodes": doc["nodes"]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=indent == 0) + ("\n" if indent else ""))
    for size in ("700b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = [json.loads(r.text) for r in elements(spark, str(tmp_path / "g.json")).orderBy("number").collect()]
            assert got == [x for v in doc.values() if isinstance(v, list) for x in v]
            g = graphs.read_json_graph(spark, str(tmp_path / "g.json"), PROGRAM)
            assert [tuple(r) for r in g.edges.orderBy("eid").collect()] == [(k, e["src"], e["dst"], e["properties"]["w"]) for k, e in enumerate(doc["edges"])]
            last = {n["id"]: (n["properties"]["a"], [1.0, n["properties"]["v"][1]]) for n in doc["nodes"]}
            assert {r.id: (r.a, r.v) for r in g.nodes.collect()} == last
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_written_by_many_tasks(spark, tmp_path):
    nodes = spark.range(500).select("id", (F.col("id") % 7).alias("a"), F.array(F.lit(0.5), F.col("id").cast("double")).alias("v")).repartition(5)
    edges = spark.range(900).select(F.col("id").alias("eid"), (F.col("id") % 500).alias("src"), (F.col("id") * 7 % 500).alias("dst"), (F.col("id") % 50).alias("w")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        graphs.write_graph_json(Graph(nodes, edges), str(tmp_path / "out"))
        graphs.write_results_json(nodes, "v", str(tmp_path / "results"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 2 and [n["id"] for n in whole["nodes"]] == list(range(500)) and [e["dst"] for e in whole["edges"]] == [k * 7 % 500 for k in range(900)]
    g = graphs.read_json_graph(spark, str(tmp_path / "out"), PROGRAM)
    assert sorted(map(tuple, g.nodes.collect())) == sorted(map(tuple, nodes.collect())) and sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, edges.collect()))
    results = json.loads("".join(p.read_text() for p in sorted((tmp_path / "results").glob("part-*"))))
    assert results["499"] == [0.5, 499.0] and list(results) == [str(i) for i in range(500)]


def test_several_documents_and_empty_arrays(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(3):
        (tmp_path / f"docs/{k}.json").write_text(json.dumps({"nodes": [{"id": k, "properties": {}}], "edges": [{"src": k, "dst": 0, "properties": {}}] * (k > 0)}))
    g = graphs.read_json_graph(spark, str(tmp_path / "docs"), parse(PROGRAMS["cc"]))
    assert sorted(map(tuple, g.nodes.collect())) == [(0, 0), (1, 0), (2, 0)] and [r.src for r in g.edges.orderBy("eid").collect()] == [1, 2]
    (tmp_path / "none.json").write_text('{"nodes":[],"edges":[]}')
    g = graphs.read_json_graph(spark, str(tmp_path / "none.json"), parse(PROGRAMS["cc"]))
    assert g.nodes.count() == g.edges.count() == 0


def test_cached_edges(spark, tmp_path, monkeypatch, capsys):
    from gasframe.__main__ import main
    from gasframe.sources import cache

    monkeypatch.setattr(cache, "BLOCK_EDGES", 40)
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60), rng.randrange(9)) for _ in range(300)] + [(7, i, 1) for i in range(50)]
    path, folder = tmp_path / "g.txt", str(tmp_path / "cache")
    path.write_text("".join(f"{a} {b} {w}\n" for a, b, w in links))
    kept = cache.cached_graph(spark, str(path), folder)
    assert sorted((r.src, r.dst, r.weight) for r in kept.edges.collect()) == sorted(links) and kept.index.count() > 4
    some = kept.of([7, 59])
    assert sorted((r.src, r.dst, r.weight) for r in some.collect()) == sorted(x for x in links if x[0] in (7, 59))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in plan and kept.of([]).count() == 0
    monkeypatch.setattr(cache, "read_edges", None)  # the text is not read again
    again = cache.cached_graph(spark, str(path), folder).graph("sssp")
    whole = graphs.read_graph(spark, str(path), "sssp")
    assert sorted(map(tuple, again.nodes.collect())) == sorted(map(tuple, whole.nodes.collect())) and sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, whole.edges.collect()))
    assert main(["simulate-raw", "sssp", str(path), folder, "2"]) == 0
    raw = capsys.readouterr().out
    assert main(["run", "sssp", str(path), "2"]) == 0 and capsys.readouterr().out == raw
    # Files of the same name, length and time elsewhere have a key of their own.
    (tmp_path / "x").mkdir()
    (tmp_path / "x/g.txt").write_text(path.read_text())
    __import__("os").utime(tmp_path / "x/g.txt", (path.stat().st_atime, path.stat().st_mtime))
    assert cache.file_key(spark, str(path)) != cache.file_key(spark, str(tmp_path / "x/g.txt"))


def test_running_sums(spark):
    rng = random.Random(2)
    values = [(k, rng.randrange(100), rng.randrange(-5, 50)) for k in rng.sample(range(10_000), 700)]
    o = Ordered(spark.createDataFrame(values, "k long, x long, y long").repartition(5), "k")
    out = o.before(a=F.col("x"), n=F.lit(1))
    out = o.before(out, b=F.when(F.col("a") % 2 == 1, F.col("y")))
    a = b = 0
    want = {}
    for n, (k, x, y) in enumerate(sorted(values)):
        want[k] = (a, n, b)
        a, b = a + x, b + (y if a % 2 else 0)
    assert {r.k: (r.a, r.n, r.b) for r in out.collect()} == want
    none = Ordered(spark.createDataFrame([], "k long, x long"), "k")
    assert none.before(a=F.col("x")).count() == 0
