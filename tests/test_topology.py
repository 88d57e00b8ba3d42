import numpy as np
import pytest
from pyspark.sql import functions as F

from gasframe.__main__ import main
from gasframe.algorithms import PROGRAMS
from gasframe.operators import statistics, topology
from gasframe.operators.graph import Graph, converge
from gasframe.plans.superstep_plan import PlanError
from gasframe.sources import tables
from gasframe.sources.generate import generate_graph
from gasframe.streaming.incremental import Incremental


def test_name_features():
    assert [topology.domain(n) for n in ("rmat-19-32", "soc-x", "ca-hollywood-2009", "x")] == ["rmat", "social", "entertainment", "other"]
    assert topology.scale_and_factor("rmat-19-32.txt") == (19.0, 32.0) and topology.scale_and_factor("graph500-scale23-ef16_adj") == (23.0, 16.0) and topology.scale_and_factor("web-x") == (None, None)


def measured(n=12):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        near = i % 2
        row = [float(x) for x in rng.normal(near * 6, 0.3, 28)]
        out.append((f"g{i}", row, {"b2l66": 10.0 + near * 5, "b4l333": 14.0 - near * 6, "c3l11": None}))
    return out


def test_model_and_evaluation():
    rows = measured()
    model = topology.train(rows)
    again = topology.TopologyModel.from_json(model.to_json())
    assert again.predict(rows[0][1]) == "b4l333" and again.predict(rows[1][1], "new") == "b2l66" and again.predict(rows[1][1], "g0") == "b4l333"
    ranked = model.rank(rows[0][1])
    assert len(ranked) == 7 and ranked[0]["probability"] == pytest.approx(1.0)
    assert topology.evaluate(rows, tuned=False) == {"cases": 12, "accuracy": 1.0, "regret": 0.0}
    with pytest.raises(ValueError):
        topology.TopologyModel.from_json('{"version": 0}')


def test_features_of_a_graph(spark):
    s = statistics.statistics(generate_graph(spark, "cc", 50, 200, 1)).first().asDict()
    f = topology.features(s, "soc-test", "txt")
    assert len(f) == sum(topology.GROUP_SIZES) == 28 and f[18] == 1.0 and f[26] == 1.0


def test_tables(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("\t".join(tables.BENCHMARK_COLUMNS) + "\nweb-a\t1\t2.5\terror\tbus error\t\t3\t4\t5\n\n")
    assert tuple(tables.read_benchmark(spark, str(tmp_path / "b.tsv")).first()) == ("web-a", 2.5, None, None, None, 3.0, 4.0, 5.0)
    (tmp_path / "logs/x").mkdir(parents=True)
    (tmp_path / "logs/x/run.log").write_text("Global graph has 7 vertices and 9 edges.\nSparse Group 0 Throughput = 2.0\nSparse Group 1 Throughput = 4\nDense Group 0 Throughput = 8.5\nTotal MTEPS (Edges / Total Time): 12.25\nTotal MTEPS (Edges / Total Time): 99\n")
    r = tables.read_profile_logs(spark, str(tmp_path / "logs")).first()
    assert tuple(r)[1:] == (7, 9, 12.25, 3.0, 8.5)
    (tmp_path / "v.csv").write_text("dataset,variant,total_mteps\n/d/web-a.TXT,bfs_270,5\nb.mtx,zz_1,6\nc,pr_1,7.5\n")
    assert [tuple(r) for r in tables.read_throughput(spark, str(tmp_path / "v.csv"), "variant").collect()] == [("web-a", "sssp", "5"), ("c", "pagerank", "7.5")]
    (tmp_path / "m.csv").write_text("Dataset,APP_MODE,MTEPS\na.txt, PR ,3\nb,CC,ERROR\nc,CC,\n")
    assert [tuple(r) for r in tables.read_throughput(spark, str(tmp_path / "m.csv"), "mode").collect()] == [("a", "pr", "3")]


def test_incremental(spark, tmp_path):
    edges = [(i, a, b) for i, (a, b) in enumerate([(1, 2), (2, 3), (5, 4), (3, 4), (4, 1), (9, 9)])]
    schema = "eid long, src long, dst long"
    start = Graph(spark.createDataFrame([(1, 1)], "id long, label long"), spark.createDataFrame([], schema))
    inc = Incremental(PROGRAMS["cc_self"], start, F.col("id"))
    for i in range(0, 6, 2):
        spark.createDataFrame(edges[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = inc.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    ids = sorted({x for _, a, b in edges for x in (a, b)})
    whole = converge(PROGRAMS["cc_self"], Graph(spark.createDataFrame([(i, i) for i in ids], "id long, label long"), spark.createDataFrame(edges, schema)), 32)
    assert {r.id: r.label for r in inc.nodes.collect()} == {r.id: r.label for r in whole.nodes.collect()}
    with pytest.raises(PlanError):
        Incremental(PROGRAMS["pagerank"], start, F.lit(1.0))


def test_command_line(spark, tmp_path, capsys):
    assert main([]) == 2 and main(["explain", "sssp"]) == 0
    (tmp_path / "g.txt").write_text("0 1 3\n1 2 1\n")
    assert main(["run", "sssp", str(tmp_path / "g.txt")]) == 0
    assert '{"2": "4"}' in capsys.readouterr().out
    assert main(["generate", "cc", "5", "9", str(tmp_path / "out")]) == 0 and main(["convert", str(tmp_path / "g.txt"), str(tmp_path / "c"), "sssp"]) == 0


def test_command_line_of_topologies(spark, tmp_path, capsys):
    folder, cache, model = tmp_path / "graphs", str(tmp_path / "cache"), str(tmp_path / "model.json")
    folder.mkdir()
    lines = ["\t".join(tables.BENCHMARK_COLUMNS)]
    for i in range(4):
        e = generate_graph(spark, "cc", 20 + 30 * i, 60 + 200 * i, i).edges.collect()
        (folder / f"web-{i}.txt").write_text("".join(f"{r.src} {r.dst}\n" for r in e))
        lines.append(f"web-{i}\t1\t2\t{3 + i % 2}\t4\t5\t6\t{7 + 2 * (i % 2)}\t8")
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n")
    table, graph = str(tmp_path / "t.tsv"), str(folder / "web-1.txt")
    assert main(["train", table, str(folder), cache, model]) == 0 and main(["predict", model, graph, cache]) == 0
    said = __import__("json").loads(capsys.readouterr().out)
    assert said["topology"] == "b3l55" and len(said["ranked"]) == 7
    assert main(["evaluate", table, str(folder), cache]) == 0 and main(["stats", graph, cache]) == 0 and main(["train", table]) == 2
    before = sorted(p.name for p in (tmp_path / "cache").iterdir())
    with open(graph, "a") as f:
        f.write("0 1\n0 1\n")
    assert main(["stats", graph, cache]) == 0 and len(before) == 4 and len(list((tmp_path / "cache").iterdir())) == 5
