"""Helpers shared by the training-data operators: shared storage, checked broadcasts, words, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasframe.sources.scratch import forget, written

#: The six ASCII white-space characters: space and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
#: A table is broadcast only if it has been written, and its rows hold at most so many bytes.
BROADCAST_BYTES = 32 << 20


def held_bytes(table: DataFrame) -> int:
    """Bytes that the rows of ``table`` hold, texts and arrays by their real lengths."""
    wide = []
    for f in table.schema.fields:
        c, name = F.col(f"`{f.name}`"), f.dataType.typeName()
        wide.append(F.octet_length(F.to_json(c)) if name in ("array", "struct", "map") else F.octet_length(c) if name in ("string", "binary") else F.lit(8))
    return table.agg(F.sum(sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(16).cast("long")))).first()[0] or 0


def checked_broadcast(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` (from ``written``) with a broadcast hint if its rows hold ``max_bytes`` at most; beyond that it is
    returned as it is and the join shuffles."""
    return F.broadcast(table) if held_bytes(table) <= max_bytes else table


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a string column, in order; an empty array if there is none."""
    bare = F.btrim(c, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN, -1))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda (a lambda's body is
    evaluated anew for each element, and with it any column expression in it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table of longs; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each is an aggregate of minima with map-side partial sums and an
    equality join, so that no node's neighbours are gathered in one place; a hot node's join partition can be split.
    Self-loops and nulls are ignored; an empty table gives an empty table.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")

    def state(x: DataFrame) -> tuple:
        r = x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum((F.xxhash64("u", "v") % 1_000_003)).alias("s")).first()
        return (r["n"], r["x"], r["s"])

    now = state(e)
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.greatest("v", "m")).alias("u"), F.least("v", "m").alias("v"))
        nxt = written(small.distinct(), "edges")
        then = state(nxt)
        for old in (e, large):
            forget(old)
        e = nxt
        if then == now:
            break
        now = then
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
