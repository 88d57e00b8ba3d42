"""Graph documents in JSON, read and written by many tasks.

A document is cut at its closing braces, wherever its lines end. How many quotes and how many open braces and brackets lie
before a piece, and so which braces are text and which close an element of an array, comes from running sums; an element's
pieces are put together again and parsed by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gasframe.operators.prefix import Ordered

_ORDER = ("file", "start", "at")
#: A document's members before an array's first element: an opening or closing brace or bracket, members that are no array
#: of elements, and the name of the array.
_STRING = r'"(?:[^"\\]|\\.)*"'
_HEAD = rf'^[\s\],}}]*(?:\{{\s*)?(?:{_STRING}\s*:\s*(?:\[\s*\]|\{{\s*\}}|{_STRING}|[^\s"\[\]{{}},]+)\s*,?\s*[\]}}]*\s*,?\s*(?:\{{\s*)?)*{_STRING}\s*:\s*\[\s*'


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, text): the text up to each closing brace, with it; of a file's last piece there is none."""
    raw = spark.read.option("lineSep", "}").text(path)
    cut = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    # The pieces and a brace for each are as long as the file, or longer by the brace that its last piece lacks.
    lasts = cut.groupBy("file").agg(F.max(F.struct("start", "at")).alias("last"), (F.sum(F.octet_length("text") + 1) > F.max("size")).alias("open"))
    closed = ~(F.col("open") & (F.struct("start", "at") == F.col("last")))
    return cut.join(F.broadcast(lasts), "file").select(*_ORDER, F.when(closed, F.concat("text", F.lit("}"))).otherwise(F.col("text")).alias("text"))


def _deepened(text: Column) -> Column:
    """Opening less closing braces and brackets of a text without strings."""
    many = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    return many("{[") - many("}]")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(number, text): the elements of the arrays in the documents at ``path``, in order, as JSON texts."""
    bare = F.regexp_replace("text", r"\\.", "")
    outside = F.regexp_replace(bare, '"[^"]*("|$)', "")
    inside = F.regexp_replace(F.regexp_replace(bare, '^[^"]*("|$)', ""), '"[^"]*("|$)', "")
    quotes = F.length(bare) - F.length(F.translate(bare, '"', ""))
    facts = _pieces(spark, path).withColumns({"q": (quotes % 2).cast("bigint"), "d0": _deepened(outside).cast("bigint"), "d1": _deepened(inside).cast("bigint")})
    placed = Ordered(facts, *_ORDER)
    f = placed.before(quotes=F.col("q")).withColumn("d", F.when(F.col("quotes") % 2 == 1, F.col("d1")).otherwise(F.col("d0")))
    f = placed.before(f, depth=F.col("d"))
    plain = (F.col("quotes") + F.col("q")) % 2 == 0
    # A document's own brace and its array's bracket are open around an element.
    f = f.withColumn("ends", (plain & (F.col("depth") + F.col("d") == 2) & F.col("text").endswith("}")).cast("bigint"))
    f = placed.before(f, number=F.col("ends"))
    piece = F.struct(*_ORDER, "text")
    whole = f.groupBy("number").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.max("ends").alias("ends"), F.min_by("depth", F.struct(*_ORDER)).alias("depth")).where("ends = 1")
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    follows = (F.col("depth") == 2) & text.rlike(r"^\s*[,{]")
    return whole.select("number", F.when(follows, F.regexp_replace(text, r"^\s*,?\s*", "")).otherwise(F.regexp_replace(text, _HEAD, "")).alias("text"))


def write_documents(sections: list[tuple[str, DataFrame]], path: str) -> None:
    """One JSON document whose arrays are ``sections``: (name, rows (key, text)), each row an element's text, in the order
    of keys. It lies at ``path`` in parts, which are the document one after the other."""
    rows = None
    for n, (name, df) in enumerate(sections):
        head = ("{" if n == 0 else "],") + f'"{name}":['
        lines = df.select(F.lit(2 * n + 1).alias("section"), F.col("key").cast("bigint").alias("key"), "text")
        first = lines.agg(F.min("key").alias("first"))
        lines = lines.join(F.broadcast(first)).select("section", "key", F.concat(F.when(F.col("key") == F.col("first"), F.lit("")).otherwise(F.lit(",")), "text").alias("value"))
        lines = lines.union(df.sparkSession.range(1).select(F.lit(2 * n), F.lit(0).cast("bigint"), F.lit(head)))
        rows = lines if rows is None else rows.union(lines)
    rows = rows.union(rows.sparkSession.range(1).select(F.lit(2 * len(sections)), F.lit(0).cast("bigint"), F.lit("]}")))
    rows.repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("value").write.mode("overwrite").text(path)


def write_object(rows: DataFrame, path: str) -> None:
    """One JSON object of ``rows`` (key, text: a member's text), in the order of keys, in parts as ``write_documents``."""
    first = rows.agg(F.min("key").alias("first"))
    lines = rows.join(F.broadcast(first)).select(F.lit(1).alias("section"), F.col("key").cast("bigint").alias("key"), F.concat(F.when(F.col("key") == F.col("first"), F.lit("")).otherwise(F.lit(",")), "text").alias("value"))
    edge = lambda n, text: rows.sparkSession.range(1).select(F.lit(n), F.lit(0).cast("bigint"), F.lit(text))
    lines = lines.union(edge(0, "{")).union(edge(2, "}"))
    lines.repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("value").write.mode("overwrite").text(path)
