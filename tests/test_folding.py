"""Reducers that are no algebra, folded without gathering a key's messages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gasframe.algorithms import PROGRAMS
from gasframe.operators import folding
from gasframe.operators.graph import gathered
from gasframe.plans.columns import Compiler, Typed
from gasframe.plans.scalars import affine, function
from gasframe.plans.superstep_plan import lower

from .test_engine import program

REDUCERS = {
    "difference": "lambda a, b: a - b", "more": "lambda a, b: a + 3 * b - 1", "half": "lambda a, b: a + b / 2", "negated": "lambda a, b: b - a", "digits": "lambda a, b: 10 * a + b", "twice": "lambda a, b: a + (a - b) * 2",
    "chain": "lambda a, b: a > b ? a - b : (a & b) + 7", "product": "lambda a, b: a * b + (b == 3 ? 1 : a / 5)", "close": "lambda a, b: !(a < b) || a == b ? ~a : b | a",
}


def wide(text, bits):
    return program("x.w", text, node=f"p: int<{bits}>", edge=f"w: int<{bits}>")


def plain(step, rows, kind="int"):
    f, out = function(step.reducer.body, step.reducer.params, kind, step.mask), {}
    for k, v, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        out[k] = f(out[k], v) if k in out else v
    return out


@pytest.mark.parametrize("name", sorted(REDUCERS))
def test_folds(spark, name):
    rng = random.Random(len(name))
    for bits, most in ((64, 1 << 62), (32, 1 << 31), (8, 200)):
        step = lower(wide(REDUCERS[name], bits))
        rows = [(rng.choice((1, 1, 1, 2, 3)), rng.randrange(-most if bits == 64 else 0, most), eid) for eid in rng.sample(range(1000), 60)] + [(9, 5, 3)]
        df = spark.createDataFrame(rows, "k long, v long, eid long").repartition(3)
        want = plain(step, rows)
        for long in (1000, 7) if bits == 32 else (7,):
            got = {r.k: r.g for r in folding.folded(df, step.reducer, "int", step.mask, long).collect()}
            assert got == want, (bits, long)


def test_plain_functions_are_the_columns(spark):
    rng = random.Random(1)
    rows = [(rng.choice((0, 1, -5, 7, 1 << 40, -(1 << 63), (1 << 63) - 1)), rng.choice((0, 3, -1, 12, 1 << 33))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a long, b long")
    for text in REDUCERS.values():
        for bits in (64, 32):
            step = lower(wide(text, bits))
            scope = {p: Typed(F.col(c), "int") for p, c in zip(step.reducer.params, "ab")}
            column = Compiler(step.mask, lambda b, n: None).compile(step.reducer.body, scope).column
            f = function(step.reducer.body, step.reducer.params, "int", step.mask)
            assert [r.g for r in df.select(column.alias("g")).collect()] == [f(a, b) for a, b in rows], text
    step = lower(program("x.w", "lambda a, b: a / b + (a == b ? 1 : 0.5)", node="p: float", edge="w: float"))
    f = function(step.reducer.body, step.reducer.params, "float", step.mask)
    assert f(3.0, 2.0) == 2.0 and f(1.0, 0.0) == math.inf and math.isnan(f(0.0, 0.0)) and f(2.0, 2.0 + 1e-8) == pytest.approx(2.0)


def test_floats_keep_their_order(spark):
    step = lower(program("x.w", "lambda a, b: a / 2 - b", node="p: float", edge="w: float"))
    rows = [(i % 3, i * 0.37, (i * 7) % 50) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, v double, eid long")
    for long in (100, 4):
        assert {r.k: r.g for r in folding.folded(df, step.reducer, "float", step.mask, long).collect()} == plain(step, rows, "float")


def test_affine():
    body = lambda text: lower(wide(text, 64)).reducer
    got = {n: (m := affine(r.body, r.params[0])) and m[0] for n, t in REDUCERS.items() if (r := body(t))}
    assert got == {"difference": 1, "more": 1, "half": 1, "negated": -1, "digits": 10, "twice": 3, "chain": None, "product": None, "close": None}


def test_plans_gather_nothing(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k long, v long, eid long")
    for text in (PROGRAMS["difference"], wide(REDUCERS["digits"], 64), wide(REDUCERS["chain"], 64)):
        out, _ = gathered(lower(text), df, Typed(F.col("v"), "int"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and out.collect() == [(1, 2)]
    # A sum and the first message need one grouping, with partial results before the shuffle.
    out, _ = gathered(lower(PROGRAMS["difference"]), df, Typed(F.col("v"), "int"))
    assert "partial_sum" in out._jdf.queryExecution().executedPlan().toString()
