"""Sums of outer products and of scaled vectors by key, in Arrow batches: what least squares gather.

A batch of messages is sorted by key and summed by numpy, symmetric matrices as packed triangles; each batch hands on one
row per key, and these partial sums are merged by key in the same way. No matrix is ever held for an edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasframe.plans.columns import Typed

#: Rows whose products are held at once, and partial sums that are unpacked at once.
_CHUNK, _MERGED = 4096, 1024


def _parts(value: Typed) -> list[tuple]:
    """(kind, whether both factors are the same, sizes) of each part of a value."""
    whole = [(p[0], p[1], p[2]) for p in value.parts] if value.kind == "tuple" else [(value.kind, value.parts, value.size)]
    return [(kind, bool(more) if kind == "outer" else False, size) for kind, more, size in whole]


def suits(value: Typed) -> bool:
    """Whether a value is an outer product or a scaled vector, or a pair of such."""
    return value.kind in ("tuple", "outer", "scaled") and all(kind in ("outer", "scaled") for kind, *_ in _parts(value))


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` numbers from an array column; what is missing is zero, and what is beyond is left out."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and (lengths == size).all() and len(flat) == size * len(column):
        return flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    out = np.zeros((len(column), size))
    for i, row in enumerate(column.to_pylist()):
        for j, x in enumerate((row or [])[:size]):
            out[i, j] = x or 0.0
    return out


def _products(column: pa.Array, kind: str, same: bool, size: tuple) -> np.ndarray:
    """What each message adds to a sum, a row of numbers: the packed triangle, the matrix, or the scaled vector."""
    u = _vectors(column.field("u"), size[0])
    if kind == "scaled":
        return u * np.nan_to_num(column.field("w").to_numpy(zero_copy_only=False).astype(float))[:, None]
    if same:
        i, j = np.triu_indices(size[0])
        return u[:, i] * u[:, j]
    return (u[:, :, None] * _vectors(column.field("w"), size[1])[:, None, :]).reshape(len(u), -1)


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first, axis=0)


def normal_sums(messages: DataFrame, value: Typed) -> tuple[DataFrame, Typed]:
    """(k, g): the sums of the messages (k, v) of each key; matrices as (rows, cols, data)."""
    parts, pair = _parts(value), value.kind == "tuple"
    widths = [size[0] * (size[0] + 1) // 2 if same else int(np.prod(size)) for _, same, size in parts]
    total, ends = sum(widths), np.cumsum(widths)
    packed = pa.schema([("k", pa.int64()), ("s", pa.list_(pa.float64()))])

    def batch_of(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * total, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), held], schema=packed)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                some = batch.slice(at, _CHUNK)
                v = some.column(1)
                columns = [v.field(i) for i in range(len(parts))] if pair else [v]
                rows = np.concatenate([_products(c, *p) for c, p in zip(columns, parts)], axis=1)
                yield batch_of(*_summed(some.column(0).to_numpy(), rows))

    def full(rows: np.ndarray, kind: str, same: bool, size: tuple) -> pa.Array:
        if kind == "outer" and same:
            n = size[0]
            i, j = np.triu_indices(n)
            whole = np.empty((len(rows), n, n))
            whole[:, i, j] = whole[:, j, i] = rows
            rows = whole.reshape(len(rows), -1)
        data = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))
        if kind == "scaled":
            return data
        side = lambda n: pa.array(np.full(len(rows), n), pa.int32())
        return pa.StructArray.from_arrays([side(size[0]), side(size[0] if same else size[1]), data], ["rows", "cols", "data"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            made = [full(x, *p) for x, p in zip(np.split(rows, ends[:-1], axis=1), parts)]
            g = pa.StructArray.from_arrays(made, [f"_{i}" for i in range(len(made))]) if pair else made[0]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), g], ["k", "g"])

        last, kept = None, None
        for batch in (b.slice(at, _MERGED) for b in batches for at in range(0, b.num_rows, _MERGED)):
            keys, rows = _summed(batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, total))
            if last is not None:
                if keys[0] == last:
                    rows[0] += kept
                else:
                    keys, rows = np.r_[last, keys], np.concatenate([kept[None], rows])
            if len(keys) > 1:
                yield out(keys[:-1], rows[:-1])
            last, kept = keys[-1], rows[-1].copy()
        if last is not None:
            yield out(np.array([last]), kept[None])

    matrix = "struct<rows:int,cols:int,data:array<double>>"
    kinds = [matrix if kind == "outer" else "array<double>" for kind, *_ in parts]
    g = f"struct<{','.join(f'_{i}:{k}' for i, k in enumerate(kinds))}>" if pair else kinds[0]
    sums = messages.select(F.col("k").cast("long").alias("k"), "v").mapInArrow(partial, "k long, s array<double>")
    done = sums.repartition("k").sortWithinPartitions("k").mapInArrow(merged, f"k long, g {g}")
    held = [("matrix", (), size if len(size) == 2 else size * 2) if kind == "outer" else ("vector", (), size) for kind, _, size in parts]
    return done, Typed(F.col("g"), "tuple", tuple(held)) if pair else Typed(F.col("g"), *held[0])
