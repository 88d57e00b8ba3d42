"""Expressions of the language as Spark columns, with the language's arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gasframe.functions.linear import solve_linear
from gasframe.plans.dsl import Binary, Call, Lit, Member, Ternary, Type, Unary, Var

TOLERANCE = 1e-6
_TWO64, _TWO63 = "18446744073709551616", "9223372036854775808"


class TypeMismatch(TypeError):
    """Operands that an operator does not take; raised when the plan is built, not row by row."""


class CallError(ValueError):
    """A function that does not exist, or arguments that it does not take."""


@dataclass(frozen=True)
class Typed:
    """A column and its kind: int, float, bool, set, array, vector, matrix, tuple (with parts) or null."""

    column: Column
    kind: str
    parts: tuple = ()
    size: tuple = ()


def kind_of(t: Type) -> tuple[str, tuple, tuple]:
    """(kind, parts, size) of a declared type; fixed-point numbers are doubles, node references longs."""
    if t.kind in ("int", "node"):
        return "int", (), ()
    if t.kind in ("float", "fixed"):
        return "float", (), ()
    if t.kind == "tuple":
        return "tuple", tuple(kind_of(a) for a in t.args), ()
    if t.kind == "vector":
        return "vector", (), t.args[1:]
    if t.kind == "matrix":
        return "matrix", (), t.args[1:]
    if t.kind == "array":
        return "array", (kind_of(t.args[0]),), ()
    return (t.kind, (), ()) if t.kind in ("bool", "set") else ("null", (), ())


def spark_type(t: Type) -> str:
    """The Spark type that holds a declared type."""
    simple = {"int": "bigint", "node": "bigint", "float": "double", "fixed": "double", "bool": "boolean", "set": "array<bigint>", "vector": "array<double>", "matrix": "struct<rows:int,cols:int,data:array<double>>"}
    if t.kind == "tuple":
        return f"struct<{','.join(f'_{i}:{spark_type(a)}' for i, a in enumerate(t.args))}>"
    if t.kind == "array":
        return f"array<{spark_type(t.args[0])}>"
    return simple.get(t.kind, "bigint")


def _signed(v: Column) -> Column:
    """A decimal modulo 2^64 as a signed long."""
    d = "decimal(38,0)"
    half, whole = F.lit(_TWO63).cast(d), F.lit(_TWO64).cast(d)
    return (F.pmod((v.cast(d) + half).cast(d), whole) - half).cast("bigint")


def _unsigned(v: Column) -> Column:
    return F.pmod(v.cast("decimal(38,0)"), F.lit(_TWO64).cast("decimal(38,0)"))


def masked(v: Column, mask: int | None) -> Column:
    return v if mask is None else v.bitwiseAND(F.lit(mask))


def wrapped(op: str, a: Column, b: Column, mask: int | None, small: int | None = None) -> Column:
    """``a op b`` modulo 2^64, then the mask, whatever the session's overflow rule.

    Arithmetic modulo 2^w needs the lower w bits of its operands only, so that a narrow mask rules overflow out; else
    products go through decimals, and unmasked sums and differences only where the quick way overflows. ``small`` is the
    value of an operand that is a literal. Operands appear once or twice, so that nested expressions stay short.
    """
    quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    x, y = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    if mask is None or mask >= 1 << 62:
        slow = _signed(x + y if op == "+" else x - y if op == "-" else x * y)
        return masked(F.coalesce(quick(a, b), slow), mask)
    a, b = masked(a, mask), masked(b, mask)
    if op == "+":
        return masked(a + b, mask)
    if op == "-":
        return masked(a - b, mask)
    if mask < 1 << 31 or small is not None and 0 <= small * mask < 1 << 63:
        return masked(a * b, mask)
    d = "decimal(38,0)"
    return F.pmod((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(d), F.lit(str(mask + 1)).cast(d)).cast("bigint")


def divided(a: Column, b: Column, mask: int | None) -> Column:
    """Unsigned 64-bit division; by zero it is zero."""
    fast = F.coalesce(F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"))
    x, y = _unsigned(a), F.nullif(_unsigned(b), F.lit(0).cast("decimal(38,0)"))
    slow = F.coalesce(_signed((x - F.pmod(x, y)) / y), F.lit(0).cast("bigint"))
    return masked(F.when((a >= 0) & (b >= 0), fast).otherwise(slow), mask)


def float_divided(a: Column, b: Column) -> Column:
    """IEEE division: a non-zero number by zero is infinite, zero by zero is not a number."""
    inf = F.lit(float("inf"))
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, at_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def compared(op: str, a: Column, b: Column, floats: bool) -> Column:
    """Order of numbers through doubles; nothing compares with what is not a number."""
    x, y = a.cast("double"), b.cast("double")
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return out & ~F.isnan(x) & ~F.isnan(y) if floats else out


def equal(a: Typed, b: Typed) -> Column:
    """Equality: floats and vectors within 1e-6, sets as sets, integers and floats never."""
    if a.kind != b.kind:
        return F.lit(False)
    if a.kind == "float":
        return F.abs(a.column - b.column) < TOLERANCE
    if a.kind in ("vector", "matrix"):
        x, y = (a.column, b.column) if a.kind == "vector" else (a.column["data"], b.column["data"])
        near = F.forall(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.coalesce(F.abs(p["x"] - p["y"]) < TOLERANCE, F.lit(False)))
        return (F.size(x) == F.size(y)) & near
    if a.kind == "set":
        return F.array_sort(a.column) == F.array_sort(b.column)
    return a.column == b.column


def _zipped(a: Column, b: Column, f: Callable) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f)


def _add(x: Column, y: Column) -> Column:
    return x + y


class Compiler:
    """Compiles expressions; ``scope`` names typed columns, ``member`` resolves fields of records."""

    def __init__(self, mask: int | None, member: Callable[[object, str | int], Typed | None]):
        self.mask, self.member = mask, member

    def compile(self, e, scope: dict[str, Typed]) -> Typed:
        if isinstance(e, Lit):
            kind = "bool" if isinstance(e.value, bool) else "int" if isinstance(e.value, int) else "float"
            return Typed(F.lit(e.value).cast("bigint") if kind == "int" else F.lit(e.value), kind)
        if isinstance(e, Var):
            if e.name in scope:
                return scope[e.name]
            found = self.member(e, "")
            if found is None:
                raise TypeMismatch(f"{e.name} is no value")
            return found
        if isinstance(e, Member):
            found = self.member(e.base, e.name)
            return found if found is not None else self._part(self.compile(e.base, scope), e.name)
        if isinstance(e, Unary):
            return self._unary(e.op, self.compile(e.value, scope))
        if isinstance(e, Ternary):
            test, then, other = (self.compile(x, scope) for x in (e.test, e.then, e.other))
            if test.kind != "bool":
                raise TypeMismatch("a condition is a bool")
            if then.kind != other.kind:
                if {then.kind, other.kind} != {"int", "float"}:
                    raise TypeMismatch(f"branches of {then.kind} and {other.kind}")
                then, other = (Typed(x.column.cast("double"), "float") for x in (then, other))
            return Typed(F.when(test.column, then.column).otherwise(other.column), then.kind, then.parts, then.size)
        if isinstance(e, Binary):
            literal = next((x.value for x in (e.left, e.right) if isinstance(x, Lit) and type(x.value) is int), None)
            return self._binary(e.op, self.compile(e.left, scope), self.compile(e.right, scope), literal)
        if isinstance(e, Call):
            return self._call(e.name, [self.compile(a, scope) for a in e.args])
        raise TypeMismatch(repr(e))

    def _part(self, base: Typed, name) -> Typed:
        if name == "id" and base.kind == "int":
            return base
        if isinstance(name, int):
            if base.kind == "tuple" and name < len(base.parts):
                return Typed(base.column[f"_{name}"], *base.parts[name])
            if base.kind == "vector":
                return Typed(base.column[name], "float")
            if base.kind == "array":
                return Typed(base.column[name], *base.parts[0])
        raise TypeMismatch(f"{base.kind} has no part {name}")

    def _unary(self, op: str, v: Typed) -> Typed:
        if op == "!" and v.kind == "bool":
            return Typed(~v.column, "bool")
        if op == "~" and v.kind == "int":
            return Typed(masked(F.bitwise_not(v.column), self.mask), "int")
        raise TypeMismatch(f"{op} of {v.kind}")

    def _binary(self, op: str, a: Typed, b: Typed, literal: int | None = None) -> Typed:
        numbers = a.kind in ("int", "float") and b.kind in ("int", "float")
        ints = a.kind == b.kind == "int"
        if op in ("==", "!="):
            same = equal(a, b)
            return Typed(same if op == "==" else ~same, "bool")
        if op in ("&&", "||") and a.kind == b.kind == "bool":
            return Typed(a.column & b.column if op == "&&" else a.column | b.column, "bool")
        if op in ("<", "<=", ">", ">=") and numbers:
            return Typed(compared(op, a.column, b.column, not ints), "bool")
        if op in ("&", "|") and ints:
            v = a.column.bitwiseAND(b.column) if op == "&" else a.column.bitwiseOR(b.column)
            return Typed(masked(v, self.mask), "int")
        if op in ("+", "-", "*") and ints:
            return Typed(wrapped(op, a.column, b.column, self.mask, literal), "int")
        if op == "/" and ints:
            return Typed(divided(a.column, b.column, self.mask), "int")
        if op in ("+", "-", "*", "/") and numbers:
            x, y = a.column.cast("double"), b.column.cast("double")
            return Typed({"+": x + y, "-": x - y, "*": x * y}[op] if op != "/" else float_divided(x, y), "float")
        if op == "+" and a.kind == b.kind == "vector":
            return Typed(_zipped(a.column, b.column, _add), "vector", (), min(a.size, b.size))
        raise TypeMismatch(f"{a.kind} {op} {b.kind}")

    def _call(self, name: str, a: list[Typed]) -> Typed:
        kinds = [x.kind for x in a]
        c = [x.column for x in a]
        if name == "make_set" and kinds == ["int"]:
            return Typed(F.array(c[0]), "set")
        if name == "set_union" and kinds == ["set", "set"]:
            return Typed(F.array_sort(F.array_union(*c)), "set")
        if name == "set_insert" and kinds == ["set", "int"]:
            return Typed(F.array_sort(F.array_union(c[0], F.array(c[1]))), "set")
        if name == "mex" and kinds == ["set"]:
            return Typed(F.array_min(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size(c[0]).cast("bigint")), c[0])), "int")
        if name == "pair" and len(a) == 2:
            return Typed(F.struct(c[0].alias("_0"), c[1].alias("_1")), "tuple", tuple((x.kind, x.parts, x.size) for x in a))
        if name == "outer_product" and kinds == ["vector", "vector"]:
            data = F.flatten(F.transform(c[0], lambda x: F.transform(c[1], lambda y: x * y)))
            return Typed(F.struct(F.size(c[0]).alias("rows"), F.size(c[1]).alias("cols"), data.alias("data")), "matrix", (), a[0].size + a[1].size)
        if name == "vector_scale" and kinds[:1] == ["vector"] and kinds[1:] in (["int"], ["float"]):
            return Typed(F.transform(c[0], lambda x: x * c[1].cast("double")), "vector", (), a[0].size)
        if name == "vector_add" and kinds == ["vector", "vector"]:
            return Typed(_zipped(c[0], c[1], _add), "vector", (), min(a[0].size, a[1].size))
        if name == "matrix_add" and kinds == ["matrix", "matrix"]:
            data = _zipped(c[0]["data"], c[1]["data"], _add)
            return Typed(F.struct(c[0]["rows"].alias("rows"), c[0]["cols"].alias("cols"), data.alias("data")), "matrix", (), a[0].size)
        if name == "solve_linear" and kinds == ["matrix", "vector"]:
            return Typed(solve_linear(*c), "vector", (), a[1].size)
        known = ("make_set", "set_union", "set_insert", "mex", "pair", "outer_product", "vector_scale", "vector_add", "matrix_add", "solve_linear")
        raise CallError(f"{name}({', '.join(kinds)})" + ("" if name in known else ": no such function"))
