"""python -m gasframe explain PROGRAM | generate APP NODES EDGES OUT [SEED] | convert GRAPH OUT APP | run PROGRAM GRAPH [STEPS]
| simulate-raw APP GRAPH CACHE [STEPS] | stats GRAPH CACHE | train TABLE GRAPHS CACHE MODEL | evaluate TABLE GRAPHS CACHE | predict MODEL GRAPH CACHE

PROGRAM is a file or the name of a built-in program; GRAPH is a .json, .txt, .mtx or Parquet folder (nodes and edges).
TABLE holds the scores of data sets by topology, GRAPHS is a folder with a .txt, .mtx or .parquet graph for each of them,
CACHE a folder that keeps statistics and edges, APP a built-in program, and MODEL a JSON file.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from gasframe.algorithms import PROGRAMS
from gasframe.operators import topology
from gasframe.operators.graph import explain, run
from gasframe.plans.dsl import parse
from gasframe.sources import generate, graphs, tables
from gasframe.sources.cache import cached_graph, cached_statistics


def _program(name: str) -> str:
    if name in PROGRAMS:
        return PROGRAMS[name]
    with open(name, encoding="utf-8") as f:
        return f.read()


def _dataset(path: str) -> tuple[str, str]:
    """A graph file's data set and format."""
    name, _, kind = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
    return name, kind


def _row(spark: SparkSession, path: str, cache: str) -> list[float]:
    return topology.features(cached_statistics(spark, path, cache).first().asDict(), *_dataset(path))


def _measured(spark: SparkSession, table: str, folder: str, cache: str) -> list[tuple]:
    """(data set, features, scores) of the data sets that have scores and a graph; tens of them."""
    scores = {r["dataset"]: {k: v for k, v in r.asDict().items() if k != "dataset"} for r in tables.read_benchmark(spark, table).collect()}
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = sorted(str(s.getPath()) for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))
    return [(name, _row(spark, path, cache), scores[name]) for path in found for name, kind in [_dataset(path)] if name in scores and kind in ("txt", "mtx", "parquet")]


def _topology(spark: SparkSession, verb: str, rest: list[str]) -> None:
    if verb == "stats":
        print(json.dumps(cached_statistics(spark, rest[0], rest[1]).first().asDict()))
    elif verb == "train":
        model = topology.train(_measured(spark, *rest[:3]))
        with open(rest[3], "w", encoding="utf-8") as f:
            f.write(model.to_json())
    elif verb == "evaluate":
        print(json.dumps(topology.evaluate(_measured(spark, *rest[:3]))))
    else:
        with open(rest[0], encoding="utf-8") as f:
            model = topology.TopologyModel.from_json(f.read())
        row, name = _row(spark, rest[1], rest[2]), _dataset(rest[1])[0]
        print(json.dumps({"topology": model.predict(row, name), "ranked": model.rank(row, name)}))


def main(args: list[str]) -> int:
    verb, rest = (args[0], args[1:]) if args else ("", [])
    if verb == "explain" and len(rest) == 1:
        print(explain(_program(rest[0])))
        return 0
    if len(rest) < {"generate": 4, "convert": 3, "run": 2, "simulate-raw": 3, "stats": 2, "train": 4, "evaluate": 3, "predict": 3}.get(verb, len(rest) + 1):
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if verb in ("stats", "train", "evaluate", "predict"):
        _topology(spark, verb, rest)
    elif verb == "generate":
        app, nodes, edges, out = rest[:4]
        graphs.write_graph_parquet(generate.generate_graph(spark, app, int(nodes), int(edges), int(rest[4]) if len(rest) > 4 else 42), out)
    elif verb == "convert":
        source, out, app = rest
        graph = graphs.read_graph(spark, source, app)
        (graphs.write_graph_json if out.endswith(".json") else graphs.write_graph_parquet)(graph, out)
    else:
        text, source = _program(rest[0]), rest[1]
        program = parse(text)
        if verb == "simulate-raw":
            graph = cached_graph(spark, source, rest.pop(2)).graph(rest[0])
        elif source.endswith(".json"):
            graph = graphs.read_json_graph(spark, source, program)
        elif source.endswith((".txt", ".mtx")):
            graph = graphs.read_graph(spark, source, rest[0])
        else:
            graph = graphs.read_graph_parquet(spark, source)
        out = run(text, graph, int(rest[2]) if len(rest) > 2 else None)
        for r in graphs.results(out.nodes, program.target).toLocalIterator():
            print(json.dumps({str(r["id"]): r["value"]}))
        print(f"steps {out.steps}, converged {out.converged}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
