"""Reducers that are no algebra, folded over a key's messages in edge order without holding them in one place.

Three ways, by what the reducer is. If it adds to what it has something that depends on the message alone (``a - b``), a
grouped sum and the first message say all. If it is a number times what it has and something that depends on the message
(``3 * a + b``), it is a map that composes: parts of a key's messages are composed side by side. Any other is a chain: a
task passes sorted messages one by one and holds one value. A key of very many messages is cut into parts by edge number,
and each part goes on from what the one before has handed on.
"""

from __future__ import annotations

from itertools import groupby
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gasframe.plans.columns import Compiler, Typed, masked
from gasframe.plans.dsl import Lambda
from gasframe.plans.scalars import affine, function, signed, supported
from gasframe.sources.scratch import forget, written

#: Messages of a key that one task passes.
LONG = 1 << 20


def folds(reducer: Lambda, kind: str) -> bool:
    """Whether a reducer over values of ``kind`` can be folded here."""
    return kind in ("int", "float") and supported(reducer.body)


def _shifted(messages: DataFrame, reducer: Lambda, q, mask: int | None) -> DataFrame:
    """(k, g) for a + q(b): the first message, and the sum of q of the others."""
    from gasframe.operators.graph import _wide_sum

    a, b = reducer.params
    part = Compiler(mask, lambda base, name: None).compile(q, {b: Typed(F.col("v"), "int")}).column
    narrow = mask is not None and mask < 1 << 40
    total = F.sum(masked(part, mask)) if narrow else _wide_sum(part, None)
    first = F.min(F.struct("eid", "v", part.alias("q")))
    agg = messages.groupBy("k").agg(first.alias("f"), total.alias("t"), F.count("*").alias("n"))
    wide = "decimal(38,0)"
    from gasframe.plans.columns import _signed

    whole = _signed((F.col("f.v").cast(wide) + F.col("t").cast(wide) - F.col("f.q").cast(wide)).cast(wide))
    return agg.select("k", F.when(F.col("n") == 1, F.col("f.v")).otherwise(masked(whole, mask)).alias("g"))


def _passed(rows: DataFrame, f, carried: bool) -> DataFrame:
    """(k, g) of sorted rows (k, v, and what a key brings along, if ``carried``), folded from left to right."""
    kind = rows.schema["v"].dataType.simpleString()
    schema = pa.schema([("k", pa.int64()), ("g", pa.float64() if kind == "double" else pa.int64())])

    def run(batches):
        key, held, known = None, None, False
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            start = cols[2] if carried else [None] * len(cols[0])
            keys, out = [], []
            for k, v, c in zip(cols[0], cols[1], start):
                if not known or k != key:
                    if known:
                        keys.append(key)
                        out.append(held)
                    key, known = k, True
                    held = v if c is None else f(c, v)
                else:
                    held = f(held, v)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, schema.field(1).type)], schema=schema)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([held], schema.field(1).type)], schema=schema)

    return rows.mapInArrow(run, f"k long, g {kind}")


def _composed(parts: DataFrame, f, p: int, q, mask: int | None) -> DataFrame:
    """(k, g) of long keys whose parts (k, part, eid, v) are sorted: each is one map x -> m x + c, and maps compose in
    the order of parts. Integers only, modulo 2^64."""
    whole = (1 << 64) - 1

    def maps(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (k, part), own in groupby(rows, key=lambda r: r[:2]):
            first, m, c = next(own)[2], 1, 0
            for r in own:
                m, c = p * m & whole, (p * c + q(0, r[2])) & whole
            start = (p * m & whole, (m * q(0, first) + c) & whole)
            yield pa.RecordBatch.from_pydict({"k": [k], "part": [part], "v": [signed((m * first + c) & whole)], "m": [signed(start[0])], "c": [signed(start[1])]})

    def joined(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for k, own in groupby(rows, key=lambda r: r[0]):
            held = next(own)[2]
            for _, _, _, m, c in own:
                held = (m * held + c) & whole
            held = signed(held & whole)
            yield pa.RecordBatch.from_pydict({"k": [k], "g": [held if mask is None else held & mask]})

    made = parts.select("k", "part", "v").mapInArrow(maps, "k long, part long, v long, m long, c long")
    return made.repartition("k").sortWithinPartitions("k", "part").mapInArrow(joined, "k long, g long")


def folded(messages: DataFrame, reducer: Lambda, kind: str, mask: int | None, long: int | None = None) -> DataFrame:
    """(k, g) of ``messages`` (k, v, eid): the reducer applied from the first to the last message by edge number."""
    long = long or LONG
    a, b = reducer.params
    map_ = affine(reducer.body, a) if kind == "int" else None
    if map_ and map_[0] == 1:
        return _shifted(messages, reducer, map_[1], mask)
    f = function(reducer.body, (a, b), kind, mask)
    held = written(messages.select(F.col("k").cast("long").alias("k"), "v", "eid"), "messages")
    many = written(held.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > long), "many")
    sizes = many.agg(F.sum("n").alias("n")).first()
    if not sizes["n"]:
        return _passed(held.repartition("k").sortWithinPartitions("k", "eid").select("k", "v"), f, False)
    few = F.broadcast(many.select("k"))
    short = _passed(held.join(few, "k", "left_anti").repartition("k").sortWithinPartitions("k", "eid").select("k", "v"), f, False)
    cut = held.join(few, "k", "left_semi").repartitionByRange(ceil(sizes["n"] / long), "k", "eid").sortWithinPartitions("k", "eid").withColumn("part", F.spark_partition_id())
    parts = written(cut, "parts")
    if map_:
        q = function(map_[1], (a, b), kind, None)
        done = _composed(parts.repartition("k", "part").sortWithinPartitions("k", "part", "eid"), f, map_[0], q, mask)
        return short.union(done)
    turn = F.row_number().over(Window.partitionBy("k").orderBy("part"))
    order = written(parts.select("k", "part").distinct().withColumn("turn", turn), "order")
    rounds, carry = order.agg(F.max("turn")).first()[0], None
    for t in range(1, rounds + 1):
        own = parts.join(F.broadcast(order.where(F.col("turn") == t).select("k", "part")), ["k", "part"])
        own = own.join(F.broadcast(carry.withColumnRenamed("g", "c")), "k") if carry is not None else own
        own = own.repartition("k").sortWithinPartitions("k", "eid").select("k", "v", *(["c"] if carry is not None else []))
        nxt = _passed(own, f, carry is not None)
        if carry is not None:
            nxt = nxt.union(carry.join(order.where(F.col("turn") == t), "k", "left_anti").select("k", "g"))
        nxt = written(nxt, "carry")
        if carry is not None:
            forget(carry)
        carry = nxt
    return short.union(carry)
