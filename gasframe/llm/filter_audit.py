"""How five document filters interact: what each removes at each place of every order in which they can stand."""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gasframe.llm.common import checked_broadcast, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
_SIGNS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INNER = bytes(range(0x80, 0xC0))
#: Copies from which a text counts as hot: more than one row in so many, so that there are no more hot texts than this.
HOT_SHARE = 100_000
#: Rows whose places are looked up at once, and parts whose counts a task holds before it hands them on.
_CHUNK, _PARTS = 4096, 256
#: Where each filter stands: place[order, step] is the number of its filter.
_PLACE = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
_COUNTS = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def first_failures() -> np.ndarray:
    """The 32 x 120 table of the step (from 0) at which a document that fails the filters of a mask (bit 0 is A) goes, by
    mask and order; 5 if none removes it."""
    fails = np.arange(1 << STEPS)[:, None, None] >> _PLACE & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


_TABLE = first_failures()


def failure_mask(data: bytes) -> int:
    """The filters A to D that one UTF-8 text fails, as bits 0 to 3."""
    words = data.split()
    n, chars = len(words), len(data.translate(None, _INNER))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    signs = len(data.translate(None, _SIGNS)) < len(data)
    return (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * chars) << 2 | signs << 3


def _facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, key) of each row: the filters A to D that its text fails, and 128 bits that stand for the text."""

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            mask = pa.array([failure_mask(t) for t in texts], pa.int32())
            key = pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mask, key], ["id", "part", "mask", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, mask int, key binary")


def _with_copies(facts: DataFrame) -> DataFrame:
    """``facts`` with bit 4 of the mask set where a smaller id has the same text. The least id of each text is found by
    a grouped minimum; texts of very many copies, which are few, meet their rows by broadcast."""
    copied = written(facts.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "copied")
    limit = facts.count() / HOT_SHARE
    hot, cold = copied.where(F.col("n") > limit).drop("n"), copied.where(F.col("n") <= limit).drop("n")
    late = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    marked = lambda x: x.select("id", "part", F.when(late, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    rest = facts.join(F.broadcast(hot), "key", "left_anti")
    return marked(facts.join(F.broadcast(hot), "key")).union(marked(rest.join(cold, "key", "left")))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with good and toxic as 0 or 1, from ``labels``; rows without an id have none."""
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    known = checked_broadcast(written(known.where("good + toxic > 0"), "labels"))
    named = rows.where(F.col("id").isNotNull()).join(known, "id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return named.union(rows.where(F.col("id").isNull()).select("part", "mask", F.lit(0), F.lit(0)))


def _partial(mask: np.ndarray, part: np.ndarray, good: np.ndarray, toxic: np.ndarray, parts: int) -> np.ndarray:
    """Counts [part, order, what, step] of rows: what is kept in the end (at step 0), then removed, redundant,
    unique_fails, good_lost and toxic_lost."""
    n = len(ORDERS)
    out = np.zeros((parts, n, 1 + len(_COUNTS), STEPS), np.int64)
    for at in range(0, len(mask), _CHUNK):
        own = slice(at, at + _CHUNK)
        cell = (part[own, None] * n + np.arange(n)) * (STEPS + 1) + _TABLE[mask[own]]
        count = lambda rows: np.bincount(cell[rows].ravel(), minlength=parts * n * (STEPS + 1)).reshape(parts, n, STEPS + 1)
        removed = count(slice(None))
        by_mask = np.bincount(part[own] * 32 + mask[own], minlength=parts * 32).reshape(parts, 32)
        fails = np.stack([by_mask[:, np.arange(32) >> f & 1 == 1].sum(axis=1) for f in range(STEPS)], axis=1)
        out[:, :, 0, 0] += removed[:, :, STEPS]
        out[:, :, 1] += removed[:, :, :STEPS]
        out[:, :, 2] += fails[:, _PLACE] - removed[:, :, :STEPS]
        out[:, :, 3] += by_mask[:, 1 << np.arange(STEPS)][:, _PLACE]
        out[:, :, 4] += count(good[own] == 1)[:, :, :STEPS]
        out[:, :, 5] += count(toxic[own] == 1)[:, :, :STEPS]
    return out


def _counted(batches):
    """Partial arrays by part and order: those of a task's rows, handed on when it ends or has met many parts."""

    def rows(held: dict):
        for part, x in held.items():
            for i in range(len(ORDERS)):
                yield {"part": part, "o": i, "counts": x[i].ravel().tolist()}

    schema = pa.schema([("part", pa.string()), ("o", pa.int32()), ("counts", pa.list_(pa.int64()))])
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        mask, good, toxic = (batch.column(i).to_numpy() for i in (1, 2, 3))
        order = np.argsort(code, kind="stable")
        for at in range(0, len(names), _PARTS):
            own = order[(code[order] >= at) & (code[order] < at + _PARTS)]
            some = names[at : at + _PARTS]
            for name, x in zip(some, _partial(mask[own], code[own] - at, good[own], toxic[own], len(some))):
                held[name] = held[name] + x if name in held else x
            if len(held) >= _PARTS:
                yield pa.RecordBatch.from_pylist(list(rows(held)), schema)
                held = {}
    if held:
        yield pa.RecordBatch.from_pylist(list(rows(held)), schema)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row per part,
    order of the filters and step, zeros included.

    A document fails A with fewer than 200 words, B if fewer than half of its words are distinct, C if more than 2 % of
    its code points are in ``[A-Z]``, D with any of ``#$%&*|``, and E if a smaller id has the same text anywhere. Tasks
    look up the step at which each document goes in a table by failures and order, and hand on counts alone. ``shapley``
    sums what a step's filter removes over all orders.

    A null text is empty, and fails A alone; a null part is the part named by the empty string. A row without an id has
    no label, is nobody's earlier copy and has none itself; rows with equal ids and texts are not copies of each other.
    A label is set if any row of ``labels`` for the id sets it. Very long texts are read whole; other columns are not
    read; an empty table gives no rows.
    """
    facts = written(_facts(docs, id_col, text_col, part_col), "facts")
    rows = _labelled(_with_copies(facts), labels, id_col)
    partial = rows.mapInArrow(_counted, "part string, o int, counts array<bigint>")
    width = (1 + len(_COUNTS)) * STEPS
    sums = partial.groupBy("part", "o").agg(*(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(width) if not 0 < i < STEPS))
    at = lambda what, step: F.col(f"c{(what * STEPS) + step}")
    kept = lambda step: sum((at(1, s) for s in range(step + 1, STEPS)), at(0, 0))
    steps = F.array(*(F.struct(F.lit(s + 1).alias("step"), kept(s).alias("kept"), *(at(1 + i, s).alias(c) for i, c in enumerate(_COUNTS))) for s in range(STEPS)))
    names = F.array(*map(F.lit, ORDERS))
    out = sums.select("part", names[F.col("o")].alias("filter_order"), F.explode(steps).alias("x")).select("part", "filter_order", "x.*")
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", F.expr("substr(filter_order, step, 1)"))))

