"""Solving small dense systems, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RIDGE = 1e-6
#: Systems that are held as arrays at once.
STACK = 1024
#: A pivot that no row below exceeds counts as this much at least, so that a singular system has a solution.
LEAST_PIVOT = 1e-12


def eliminated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems (k x n x n, k x n) by elimination with partial pivoting, all systems at once."""
    n, every = a.shape[1], np.arange(len(a))
    both = np.concatenate([a, b[..., None]], axis=2)
    for i in range(n):
        below = np.abs(both[:, i:, i])
        best = np.nan_to_num(below).argmax(axis=1)
        flat = ~(below[every, best] >= LEAST_PIVOT)
        at = np.where(flat, i, i + best)
        both[every, at], both[:, i] = both[:, i].copy(), both[every, at]
        both[flat, i, i] = LEAST_PIVOT
        both[:, i] /= both[:, i, i][:, None]
        factor = both[:, :, i].copy()
        factor[:, i] = 0.0
        both -= factor[..., None] * both[:, i][:, None, :]
    return both[:, :, n]


def solve_batch(rows: pd.Series, cols: pd.Series, data: pd.Series, right: pd.Series) -> pd.Series:
    """Solutions of (A + RIDGE I) x = b, stacked by size, ``STACK`` at once. A singular system is solved with its least pivots. A system
    that is not square, or does not fit its right side, is an error; a row without a matrix has no solution."""
    out: list = [None] * len(right)
    sizes: dict[int, list[int]] = {}
    for i, (r, c, a, b) in enumerate(zip(rows, cols, data, right)):
        if a is None or b is None or r is None or r != r:
            continue
        if r != c or len(b) != r or len(a) != r * c:
            raise ValueError(f"solve_linear needs a square matrix and a vector that fits it, not {r} x {c} and {len(b)}")
        sizes.setdefault(int(r), []).append(i)
    for n, at in sizes.items():
        if not n:
            for i in at:
                out[i] = []
            continue
        for some in (at[j : j + STACK] for j in range(0, len(at), STACK)):
            a = np.stack([np.asarray(data.iloc[i], float) for i in some]).reshape(-1, n, n) + RIDGE * np.eye(n)
            b = np.stack([np.asarray(right.iloc[i], float) for i in some])
            for i, x in zip(some, eliminated(a, b)):
                out[i] = x.copy()
    return pd.Series(out)


def solve_linear(matrix: Column, vector: Column) -> Column:
    return F.pandas_udf(solve_batch, "array<double>")(matrix["rows"], matrix["cols"], matrix["data"], vector)
