"""Expressions of the language over plain numbers, with the language's arithmetic: for reducers that Spark cannot group."""

from __future__ import annotations

import math
from collections.abc import Callable

from gasframe.plans.columns import TOLERANCE
from gasframe.plans.dsl import Binary, Lit, Ternary, Unary, Var


def kind_of_value(e, kind: str) -> str:
    """int, float or bool: the kind of an expression whose variables are of ``kind``."""
    if isinstance(e, Lit):
        return "bool" if isinstance(e.value, bool) else "int" if isinstance(e.value, int) else "float"
    if isinstance(e, Var):
        return kind
    if isinstance(e, Unary):
        return "bool" if e.op == "!" else "int"
    if isinstance(e, Ternary):
        return "float" if "float" in (kind_of_value(e.then, kind), kind_of_value(e.other, kind)) else kind_of_value(e.then, kind)
    if e.op in ("==", "!=", "<", "<=", ">", ">=", "&&", "||"):
        return "bool"
    return "float" if "float" in (kind_of_value(e.left, kind), kind_of_value(e.right, kind)) else "int"


def supported(e) -> bool:
    """Whether an expression uses numbers, conditions and operators alone."""
    if isinstance(e, (Lit, Var)):
        return True
    if isinstance(e, Unary):
        return supported(e.value)
    if isinstance(e, Ternary):
        return supported(e.test) and supported(e.then) and supported(e.other)
    return isinstance(e, Binary) and supported(e.left) and supported(e.right)


def signed(v: int) -> int:
    return ((v + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def _divided(a: float, b: float) -> float:
    if b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
    return a / b


_WHOLE = (1 << 64) - 1
_INTS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "&": lambda a, b: a & b, "|": lambda a, b: a | b,
    "/": lambda a, b: (a & _WHOLE) // (b & _WHOLE) if b & _WHOLE else 0,
}
_FLOATS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divided}
_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def function(e, params: tuple[str, str], kind: str, mask: int | None) -> Callable:
    """``e`` as a function of two numbers of ``kind``."""
    of = lambda x: function(x, params, kind, mask)
    wrap = signed if mask is None else lambda v: v & mask
    if isinstance(e, Lit):
        return lambda a, b: e.value
    if isinstance(e, Var):
        return (lambda a, b: a) if e.name == params[0] else (lambda a, b: b)
    if isinstance(e, Unary):
        v = of(e.value)
        return (lambda a, b: not v(a, b)) if e.op == "!" else (lambda a, b: wrap(~v(a, b)))
    if isinstance(e, Ternary):
        test, then, other = of(e.test), of(e.then), of(e.other)
        if kind_of_value(e, kind) == "float":
            return lambda a, b: float(then(a, b) if test(a, b) else other(a, b))
        return lambda a, b: then(a, b) if test(a, b) else other(a, b)
    x, y = of(e.left), of(e.right)
    kinds = kind_of_value(e.left, kind), kind_of_value(e.right, kind)
    if e.op in ("==", "!="):
        if kinds[0] != kinds[1]:
            same = lambda a, b: False
        elif kinds[0] == "float":
            same = lambda a, b: abs(a - b) < TOLERANCE
        else:
            same = lambda a, b: a == b
        return (lambda a, b: same(x(a, b), y(a, b))) if e.op == "==" else (lambda a, b: not same(x(a, b), y(a, b)))
    if e.op in _ORDER:
        compare = _ORDER[e.op]
        return lambda a, b: compare(float(x(a, b)), float(y(a, b)))
    if e.op in ("&&", "||"):
        return (lambda a, b: x(a, b) and y(a, b)) if e.op == "&&" else (lambda a, b: x(a, b) or y(a, b))
    if kinds == ("int", "int"):
        op = _INTS[e.op]
        return lambda a, b: wrap(op(x(a, b), y(a, b)))
    op = _FLOATS[e.op]
    return lambda a, b: op(float(x(a, b)), float(y(a, b)))


def affine(e, a: str) -> tuple[int, object] | None:
    """(p, q) if ``e`` is p a + q, with a number p and an expression q without ``a``; sums and products of integers only."""
    if isinstance(e, Var) and e.name == a:
        return 1, Lit(0)
    if not _holds(e, a):
        return 0, e
    if isinstance(e, Binary) and e.op in "+-":
        x, y = affine(e.left, a), affine(e.right, a)
        if x and y:
            return (x[0] + y[0] if e.op == "+" else x[0] - y[0]), Binary(e.op, x[1], y[1])
    if isinstance(e, Binary) and e.op == "*":
        for k, v in ((e.left, e.right), (e.right, e.left)):
            if isinstance(k, Lit) and type(k.value) is int and (x := affine(v, a)):
                return k.value * x[0], Binary("*", k, x[1])
    return None


def _holds(e, a: str) -> bool:
    if isinstance(e, Var):
        return e.name == a
    if isinstance(e, Unary):
        return _holds(e.value, a)
    if isinstance(e, Ternary):
        return any(_holds(x, a) for x in (e.test, e.then, e.other))
    return isinstance(e, Binary) and (_holds(e.left, a) or _holds(e.right, a))
