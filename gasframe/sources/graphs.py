"""Graph files: JSON documents, edge lists, Matrix Market files, Parquet tables; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasframe.operators.graph import Graph
from gasframe.plans.columns import spark_type
from gasframe.plans.dsl import Program, Type
from gasframe.sources.documents import elements, write_documents, write_object
from gasframe.sources.scratch import written


class UnsupportedFormat(ValueError):
    """A file whose extension names no graph format."""


class EmptyGraph(ValueError):
    """A file without an edge."""


def _loose(t: Type) -> str:
    """A JSON type that takes whatever the file has for a declared type, so that ill-typed values become defaults."""
    return {"set": "array<string>", "array": "array<string>", "vector": "array<string>", "matrix": "array<string>", "tuple": "array<string>"}.get(t.kind, "string")


def coerced(c: Column, t: Type) -> Column:
    """A loosely read value as its declared type, or the type's default if it is missing or ill-typed."""
    target = spark_type(t)
    if t.kind == "int":
        return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    if t.kind in ("float", "fixed"):
        return F.coalesce(c.try_cast("double"), F.lit(0.0))
    if t.kind == "bool":
        return F.coalesce(F.lower(c) == "true", F.lit(False))
    if t.kind == "set":
        return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()))), F.array().cast(target))
    numbers = F.coalesce(F.transform(c, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))), F.array().cast("array<double>"))
    fixed = lambda n: F.slice(F.concat(numbers, F.array_repeat(F.lit(0.0), n)), 1, n)
    if t.kind == "vector":
        return fixed(t.args[1])
    if t.kind == "matrix":
        rows, cols = t.args[1:]
        return F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), fixed(rows * cols).alias("data"))
    if t.kind == "tuple":
        return F.struct(*(coerced(F.get(c, i), a).alias(f"_{i}") for i, a in enumerate(t.args)))
    if t.kind == "array":
        return F.coalesce(F.transform(c, lambda x: coerced(x, t.args[0])), F.array().cast(target))
    raise ValueError(f"no default for {t}")


def read_json_graph(spark: SparkSession, path: str, program: Program) -> Graph:
    """A graph from documents ``{nodes: [{id, properties}], edges: [{src, dst, properties}]}``.

    Properties that the program does not declare are not read; missing and ill-typed ones get their type's default. Of
    nodes with one id the last in the file stays; ``eid`` is the place of an edge in the file. An element with ``src`` or
    ``dst`` is an edge, another with ``id`` a node. Files are cut and read by many tasks (``documents``), whatever their
    lines are; a folder of parts is one document.
    """
    props = lambda of: T.StructType([T.StructField(p, T._parse_datatype_string(_loose(t))) for p, t in of.items()])
    element = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "src", "dst")])
    texts = written(elements(spark, path), "elements")
    parsed = texts.select("number", "text", F.from_json("text", element).alias("e"))
    link = F.col("e.src").isNotNull() | F.col("e.dst").isNotNull()
    field = lambda p, t: coerced(F.col("p.properties").getField(p), t).alias(p)
    own = lambda df, of: df.withColumn("p", F.from_json("text", T.StructType([T.StructField("properties", props(of))])))
    rows = own(parsed.where(~link & F.col("e.id").isNotNull()), program.node)
    last = Window.partitionBy("id").orderBy(F.desc("number"))
    rows = rows.select("number", F.col("e.id").alias("id"), "p").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    nodes = rows.select("id", *(field(p, t) for p, t in program.node.items()))
    links = own(parsed.where(link), program.edge)
    first = links.agg(F.min("number").alias("first"))
    links = links.join(F.broadcast(first)).select((F.col("number") - F.col("first")).alias("eid"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), "p")
    return Graph(nodes, links.select("eid", "src", "dst", *(field(p, t) for p, t in program.edge.items())))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): the lines of text files, ``at`` ordered as they are."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))


def _fields(lines: DataFrame) -> DataFrame:
    f = F.split("line", r"\s+")
    return lines.select("at", F.get(f, F.lit(0)).try_cast("bigint").alias("src"), F.get(f, F.lit(1)).try_cast("bigint").alias("dst"), F.get(f, F.lit(2)).alias("w"), f.alias("f"))


def read_edge_list(spark: SparkSession, path: str, properties: tuple[str, ...] = ("weight",), default: int | None = None) -> DataFrame:
    """(eid, src, dst, properties...) of lines ``src dst [property ...]``. Blank lines, lines that start with # or %,
    and lines without two integers are passed over; a property that is missing or no integer is ``default``."""
    lines = _lines(spark, path).where("line != '' AND NOT line RLIKE '^[#%]'")
    held = [F.coalesce(F.get("f", F.lit(2 + i)).try_cast("bigint"), F.lit(default).cast("bigint")).alias(p) for i, p in enumerate(properties)]
    return _fields(lines).where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("at").alias("eid"), "src", "dst", *held)


def read_host_graph(spark: SparkSession, path: str, properties: tuple[str, ...] = ("weight",)) -> Graph:
    """A graph as a host program loads an edge list: any number of integer edge properties, 1 where a line has none, ids
    rebased to zero, and every id up to the largest a node."""
    edges = rebased(read_edge_list(spark, path, properties, default=1))
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    if top is None:
        raise EmptyGraph(path)
    return Graph(spark.range(top + 1), edges)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(eid, src, dst, weight) of a Matrix Market coordinate file, rebased to zero.

    After a ``%%`` header the first line of data is the size and no edge; without a header it is an edge. The last
    header says whether weights are left out (``pattern``); others are integers, or decimals cut to integers.
    """
    lines = _lines(spark, path).where("line != ''")
    heads = lines.where("line LIKE '\\%\\%%'").agg(F.count("*").alias("heads"), F.max_by(F.lower("line").contains("pattern"), F.col("at")).alias("pattern"))
    data = lines.where("NOT line LIKE '\\%%'")
    size = data.agg(F.min("at").alias("size_at")).crossJoin(heads)
    rows = _fields(data).join(F.broadcast(size)).where("src IS NOT NULL AND dst IS NOT NULL AND (heads = 0 OR at > size_at)")
    weight = F.when(~F.coalesce("pattern", F.lit(False)), F.coalesce(F.col("w").try_cast("bigint"), F.col("w").try_cast("double").try_cast("bigint")))
    return rows.select(F.col("at").alias("eid"), (F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"), weight.alias("weight"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges of a file, by its extension."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind == "parquet":
        e = spark.read.parquet(path)
        e = e if "weight" in e.columns else e.withColumn("weight", F.lit(None).cast("bigint"))
        return (e if "eid" in e.columns else e.withColumn("eid", F.monotonically_increasing_id())).select("eid", "src", "dst", "weight")
    if kind == "txt":
        return read_edge_list(spark, path)
    if kind == "mtx":
        return read_matrix_market(spark, path)
    raise UnsupportedFormat(path)


def rebased(edges: DataFrame, rebase: str = "auto") -> DataFrame:
    """Edges with ids from zero: negative ids are dropped, and ids that start at one are moved down ("auto")."""
    sound = edges.where("src >= 0 AND dst >= 0")
    if rebase != "auto":
        return sound
    low = sound.agg(F.min(F.least("src", "dst")).alias("low"))
    return sound.join(F.broadcast(low)).withColumns({c: F.col(c) - F.when(F.col("low") == 1, 1).otherwise(0) for c in ("src", "dst")}).drop("low")


def with_defaults(edges: DataFrame, app: str, dense_ids: bool = False) -> Graph:
    """A graph for a built-in program from (eid, src, dst, weight): nodes are the endpoints (with ``dense_ids`` all
    ids up to the largest), with the program's first values."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    if dense_ids:
        top = ends.agg(F.max("id")).first()[0]
        nodes = edges.sparkSession.range(0 if top is None else top + 1)
    else:
        nodes = ends.distinct()
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    if app in ("pagerank", "ar"):
        nodes = nodes.join(degree, "id", "left").withColumn("out_deg", F.greatest(F.coalesce("d", F.lit(0)), F.lit(1)).cast("bigint")).drop("d")
    root, i = F.col("id") == 0, lambda v: F.lit(v).cast("bigint")
    first = {
        "sssp": {"dist": F.when(root, i(0)).otherwise(i(999999))},
        "pagerank": {"rank": F.lit(1.0)},
        "ar": {"score": i(0)},
        "cc": {"label": F.col("id")},
        "wcc": {"label": F.col("id")},
        "bfs": {"prop": F.when(root, i((1 << 31) + 1)).otherwise(i((1 << 31) - 2))},
        "coloring": {"color": F.col("id"), "priority": F.col("id") % 1000},
        "als": {"vec": F.array_repeat(F.lit(0.0), 16)},
    }
    if app not in first:
        raise ValueError(f"no built-in program {app}")
    weight = {"sssp": [F.coalesce("weight", i(1)).alias("weight")], "als": [F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("rating")]}
    return Graph(nodes.withColumns(first[app]), edges.select("eid", "src", "dst", *weight.get(app, [])))


def read_graph(spark: SparkSession, path: str, app: str, dense_ids: bool = False) -> Graph:
    """A graph file for a built-in program; ``EmptyGraph`` if there is no edge in it."""
    edges = read_edges(spark, path)
    if edges.isEmpty():
        raise EmptyGraph(path)
    return with_defaults(rebased(edges) if dense_ids else edges, app, dense_ids)


def results(nodes: DataFrame, prop: str) -> DataFrame:
    """(id, value): a property of every node as JSON text, in the order of ids."""
    kind = nodes.schema[prop].dataType
    if isinstance(kind, (T.ArrayType, T.StructType)):
        tuple_like = isinstance(kind, T.StructType) and all(f.name == f"_{i}" for i, f in enumerate(kind.fields))
        text = F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(F.array(F.col(prop)[f.name])).substr(F.lit(2), F.length(F.to_json(F.array(F.col(prop)[f.name]))) - 2) for f in kind.fields)), F.lit("]")) if tuple_like else F.to_json(prop)
    else:
        text = F.coalesce(F.col(prop).cast("string"), F.lit("null"))
    return nodes.select("id", text.alias("value")).orderBy("id")


def write_results_json(nodes: DataFrame, prop: str, path: str) -> None:
    """A property of every node as one JSON object by id, in parts as ``write_documents`` leaves them."""
    member = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('":'), F.col("value"))
    write_object(results(nodes, prop).select(F.col("id").alias("key"), member.alias("text")), path)


def write_graph_json(graph: Graph, path: str) -> None:
    """A graph as one JSON document, nodes by id and edges by number, in parts as ``write_documents`` leaves them."""
    record = lambda df, keys: F.to_json(F.struct(*keys, F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in (*keys, "eid"))).alias("properties")))
    nodes = graph.nodes.select(F.col("id").alias("key"), record(graph.nodes, ["id"]).alias("text"))
    edges = graph.edges.select(F.col("eid").alias("key"), record(graph.edges, ["src", "dst"]).alias("text"))
    write_documents([("nodes", nodes), ("edges", edges)], path)


def write_graph_parquet(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
