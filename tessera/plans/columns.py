"""Expression nodes as Spark columns, with two-valued predicates and typed equality.

SQL NULL stands for a missing value. A value that was stored as an explicit null is also NULL, and the
mark of its field tells. Values of different types are never equal, and never coerced to each other,
except that a time compares with numbers as its epoch milliseconds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.errors import TesseraError
from tessera.functions.expr import Aggregate, Expr, Field
from tessera.sources.tables import key_text
from tessera.values import FLAG, MISSING, NUMBER, TEXT


@dataclass(frozen=True)
class Val:
    """A column with its Spark type and, for fields that can hold one, the mark of an explicit null.

    A text whose stored values may be of other types has ``key``: the equality key of such a value, else null.
    """

    col: Column
    kind: T.DataType
    null: Column | None = None
    key: Column | None = None

    def as_key(self) -> Column:
        plain = key_text(self.col, self.kind)
        return plain if self.key is None else F.coalesce(self.key, plain)

    def like(self, other: Val) -> Val:
        """A value of unknown type as one of another's type; missing where it is of a third."""
        if self.key is None or other.key is not None or other.family == "null":
            return self
        own = F.coalesce(self.key, F.lit(TEXT))
        marks = {"number": (NUMBER, "double", DOUBLE), "boolean": (FLAG, "boolean", BOOL), "time": (NUMBER, "timestamp", T.TimestampType()), "string": (TEXT, "string", STR)}
        if other.family not in marks:
            return Val(F.lit(None), T.NullType())
        mark, name, kind = marks[other.family]
        return Val(F.when(F.startswith(own, F.lit(mark)), self.col.try_cast(name)), kind, self.null)

    @property
    def family(self) -> str:
        k = self.kind
        if isinstance(k, T.NullType):
            return "null"
        if isinstance(k, T.NumericType):
            return "number"
        if isinstance(k, (T.StringType, T.CharType, T.VarcharType)):
            return "string"
        if isinstance(k, T.BooleanType):
            return "boolean"
        if isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "time"
        if isinstance(k, T.BinaryType):
            return "bytes"
        return "array" if isinstance(k, T.ArrayType) else "json"

    @property
    def fractional(self) -> bool:
        return isinstance(self.kind, T.FractionalType) and not isinstance(self.kind, T.DecimalType)

    def is_null(self) -> Column:
        """Holds an explicit null."""
        return F.lit(False) if self.null is None else self.null

    def is_missing(self) -> Column:
        return self.col.isNull() & ~self.is_null()

    def number(self) -> Column:
        """The value as it compares with numbers."""
        if self.family == "time":
            return F.unix_millis(self.col.cast("timestamp"))
        return self.col


Env = Callable[[Field], Val]
BOOL, STR, LONG, DOUBLE = T.BooleanType(), T.StringType(), T.LongType(), T.DoubleType()


def literal(value: Any) -> Val:
    if value is None:
        return Val(F.lit(None), T.NullType(), F.lit(True))
    if value is MISSING:
        return Val(F.lit(None), T.NullType())
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL)
    if isinstance(value, int):
        return Val(F.lit(value), LONG) if -(1 << 63) <= value < 1 << 63 else Val(F.lit(Decimal(value)), T.DecimalType(38, 0))
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE)
    if isinstance(value, Decimal):
        return Val(F.lit(value), T.DecimalType(38, 18))
    if isinstance(value, str):
        return Val(F.lit(value), STR)
    if isinstance(value, (datetime, date)):
        return Val(F.lit(value).cast("timestamp"), T.TimestampType())
    if isinstance(value, (bytes, bytearray)):
        return Val(F.lit(bytes(value)), T.BinaryType())
    if isinstance(value, (list, tuple)):
        items = [literal(v) for v in value]
        kinds = {i.family for i in items}
        if len(kinds) == 1:
            return Val(F.array(*[i.col for i in items]), T.ArrayType(items[0].kind))
        return Val(F.array().cast("array<string>"), T.ArrayType(STR)) if not items else Val(F.array(*[js_string(i) for i in items]), T.ArrayType(STR))
    raise TesseraError("INVALID_QUERY", f"{value!r} cannot be a literal of a query")


def comparable(a: Val, b: Val) -> tuple[Column, Column] | None:
    """The two values as they compare with each other, or None if their types never do."""
    if (a.key is not None or b.key is not None) and "null" not in (a.family, b.family):
        return a.as_key(), b.as_key()
    if a.family == b.family and a.family != "null":
        return a.col, b.col
    if {a.family, b.family} == {"number", "time"}:
        return a.number(), b.number()
    return None


def equal(a: Val, b: Val) -> Column:
    """Equality, true or false: missing equals missing, null equals null, and neither equals a value."""
    pair = comparable(a, b)
    if pair is None:
        same = a.col.isNull() & b.col.isNull()
    else:
        same = pair[0].eqNullSafe(pair[1])
    if a.null is None and b.null is None:
        return same
    return same & (a.is_null() == b.is_null())


def _ordered(op: str, a: Val, b: Val) -> Column:
    a, b = a.like(b), b.like(a)
    pair = comparable(a, b)
    if pair is None:
        return F.lit(False)
    x, y = pair
    out = {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]
    for v in (a, b):
        if v.fractional:  # NaN compares with nothing
            out = out & ~F.isnan(v.col)
    return F.coalesce(out, F.lit(False))


def truthy(v: Val) -> Column:
    """Zero, the empty string, NaN, null and missing are false."""
    if v.family == "boolean":
        out = v.col
    elif v.family == "number":
        out = (v.col != 0) & ~F.isnan(v.col) if v.fractional else v.col != 0
    elif v.family == "string":
        out = v.col != ""
    else:
        out = v.col.isNotNull()
    return F.coalesce(out, F.lit(False))


def js_string(v: Val) -> Column:
    """The value as text: whole doubles without a point, exponents with a sign."""
    if v.family == "string":
        return v.col
    if v.fractional:
        x = v.col.cast("double")
        whole = x.cast("decimal(38,0)").cast("string")
        plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
        far = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1"), r"E-", "e-")
        size = F.abs(x)
        special = F.when(F.isnan(x), "NaN").when(x == math.inf, "Infinity").when(x == -math.inf, "-Infinity").when(x == 0, "0")
        return special.when((size < 1e21) & (x == F.floor(x)), whole).when((size >= 1e-6) & (size < 1e19), plain).otherwise(far)
    if v.family == "array":
        return F.array_join(F.transform(v.col, lambda x: js_string(Val(x, v.kind.elementType))), ",", "")
    if v.family == "json":
        return F.to_json(v.col)
    if v.family == "time":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return v.col.cast("string")


def _in_array(needle: Val, array: Val) -> Column:
    if array.family != "array":
        return F.lit(False)
    item = array.kind.elementType
    found = F.exists(array.col, lambda x: equal(replace(needle, null=None), Val(x, item)))
    return F.coalesce(found & needle.col.isNotNull(), F.lit(False))


def _like(a: Val, pattern: Any, fold: bool, env: Env) -> Column:
    text = a.col if a.family == "string" else js_string(a)
    match = F.ilike if fold else F.like
    if isinstance(pattern, str):
        escape = next(c for c in "\x01\x02\x03\x04" if c not in pattern)
        return F.coalesce(match(text, F.lit(pattern), F.lit(escape)), F.lit(False))
    p = column(pattern, env)
    return F.coalesce(match(text, js_string(p), F.lit("\x01")), F.lit(False))


def _common(values: list[Val]) -> T.DataType:
    kinds = [v.kind for v in values if v.family != "null"]
    if not kinds:
        return T.NullType()
    families = {v.family for v in values if v.family != "null"}
    if families == {"number"}:
        if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds):
            return DOUBLE
        return LONG if all(isinstance(k, T.IntegralType) for k in kinds) else next(k for k in kinds if isinstance(k, T.DecimalType))
    if len(families) == 1:
        return kinds[0]
    return STR


def _aligned(values: list[Val]) -> tuple[list[Column], T.DataType]:
    """Branches of one expression under one type; mixed types become text."""
    kind = _common(values)
    cast = lambda v: js_string(v) if isinstance(kind, T.StringType) and v.family not in ("string", "null") else v.col.cast(kind)
    return [cast(v) for v in values], kind


def _arithmetic(op: str, a: Val, b: Val) -> Val:
    if op == "add" and "string" in (a.family, b.family) and "null" not in (a.family, b.family):
        return Val(F.concat(js_string(a), js_string(b)), STR)
    if a.family != "number" or b.family != "number":
        return Val(F.lit(None).cast("double"), DOUBLE)
    x, y = a.col, b.col
    if op == "divide":
        if any(isinstance(v.kind, T.DecimalType) and not v.kind.scale for v in (a, b)) and all(isinstance(v.kind, (T.IntegralType, T.DecimalType)) for v in (a, b)):
            wide = T.DecimalType(38, 0)  # large integers divide to a whole number, towards zero
            zero = y.cast(wide) == 0
            return Val(F.when(~zero, (x.cast(wide) - F.try_mod(x.cast(wide), y.cast(wide))) / F.when(~zero, y.cast(wide))).cast(wide), wide)
        return Val(F.try_divide(x.cast("double"), y.cast("double")), DOUBLE)
    out = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply}[op]
    whole = isinstance(a.kind, T.IntegralType) and isinstance(b.kind, T.IntegralType)
    kind = LONG if whole else DOUBLE
    return Val(out(x.cast(kind), y.cast(kind)), kind)


def column(node: Any, env: Env) -> Val:
    """A node as a column. ``env`` gives the column of a field (or of a folded aggregate)."""
    if isinstance(node, (Field, Aggregate)):
        return env(node)
    if not isinstance(node, Expr):
        return literal(node)
    op, args = node.op, node.args
    if op in ("like", "ilike"):
        return Val(_like(column(args[0], env), args[1], op == "ilike", env), BOOL)
    if op == "in_array" and isinstance(args[1], tuple):
        needle = column(args[0], env)
        hits = [equal(needle, literal(v)) for v in args[1]]
        out = F.lit(False)
        for h in hits:
            out = out | h
        return Val(out, BOOL)
    vals = [column(a, env) for a in args]
    if op == "eq":
        return Val(equal(*vals), BOOL)
    if op == "ne":
        return Val(~equal(*vals), BOOL)
    if op in ("gt", "gte", "lt", "lte"):
        return Val(_ordered(op, *vals), BOOL)
    if op in ("and", "or"):
        out = F.lit(op == "and")
        for v in vals:
            out = out & truthy(v) if op == "and" else out | truthy(v)
        return Val(out, BOOL)
    if op == "not":
        return Val(~truthy(vals[0]), BOOL)
    if op == "in_array":
        return Val(_in_array(*vals), BOOL)
    if op in ("starts_with", "ends_with"):
        a, b = vals
        if a.family != "string" or b.family != "string":
            return Val(F.lit(False), BOOL)
        test = F.startswith if op == "starts_with" else F.endswith
        return Val(F.coalesce(test(a.col, b.col), F.lit(False)), BOOL)
    if op == "is_undefined":
        return Val(vals[0].is_missing(), BOOL)
    if op == "is_null":
        return Val(vals[0].is_null(), BOOL)
    if op == "length":
        v = vals[0]
        if v.family == "string":  # in UTF-16 units: characters beyond the basic plane count twice
            return Val((F.char_length(v.col) + F.regexp_count(v.col, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long"), LONG)
        if v.family == "array":
            return Val(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), LONG)
        return Val(F.lit(None).cast("long"), LONG)
    if op in ("upper", "lower"):
        v = vals[0]
        return Val((F.upper if op == "upper" else F.lower)(v.col), STR) if v.family == "string" else v
    if op == "concat":
        return Val(F.concat(*[js_string(v) for v in vals]), STR)
    if op in ("add", "subtract", "multiply", "divide"):
        return _arithmetic(op, *vals)
    if op == "coalesce":
        cols, kind = _aligned(vals)
        return Val(F.coalesce(*cols), kind)
    if op == "case_when":
        (then, otherwise), kind = _aligned(vals[1:])
        return Val(F.when(truthy(vals[0]), then).otherwise(otherwise), kind)
    raise TesseraError("INVALID_QUERY", f"unknown operator {op}")


def condition(node: Any, env: Env) -> Column:
    """A node as a filter, where NULL drops a row just as false does.

    Plain comparisons stay bare here, so that they reach the scan and its statistics.
    """
    if isinstance(node, Expr) and node.op in ("and", "or") and node.args:
        out = condition(node.args[0], env)
        for a in node.args[1:]:
            out = out & condition(a, env) if node.op == "and" else out | condition(a, env)
        return out
    if isinstance(node, Expr) and node.op in ("eq", "gt", "gte", "lt", "lte"):
        a, b = (column(x, env) for x in node.args)
        if node.op != "eq":
            a, b = a.like(b), b.like(a)
        pair = comparable(a, b)
        given = [x for x in node.args if not isinstance(x, (Field, Expr, Aggregate))]
        if pair and not a.fractional and not b.fractional or pair and given and all(isinstance(x, (int, float)) and x == x for x in given):
            x, y = pair
            if node.op == "eq" and given and given[0] is not None:
                return x == y
            if node.op in ("lt", "lte"):
                return x < y if node.op == "lt" else x <= y
            if node.op in ("gt", "gte"):
                out = x > y if node.op == "gt" else x >= y
                for v in (a, b):  # NaN sorts above all numbers in SQL, and compares with none here
                    out = out & ~F.isnan(v.col) if v.fractional else out
                return out
    if isinstance(node, Expr) and node.op == "in_array" and isinstance(node.args[1], tuple):
        needle, values = column(node.args[0], env), [literal(v) for v in node.args[1]]
        if values and all(v.family == needle.family and v.family in ("string", "number") for v in values) and needle.null is None and needle.key is None:
            return needle.col.isin(list(node.args[1]))
    if isinstance(node, Expr) and node.op in ("starts_with", "ends_with"):
        a, b = (column(x, env) for x in node.args)
        if a.family == b.family == "string":
            return (F.startswith if node.op == "starts_with" else F.endswith)(a.col, b.col)
    return truthy(column(node, env))


def aggregate(node: Aggregate, env: Env) -> Column:
    """An aggregate over a group's rows; null and missing values are skipped."""
    if node.op == "count":
        return F.count(F.lit(1)) if node.arg is None else F.count(column(node.arg, env).col)
    v = column(node.arg, env)
    if node.op in ("sum", "avg"):
        if v.family not in ("number", "null"):
            raise TesseraError("INVALID_QUERY", f"{node.op} needs numbers")
        if node.op == "avg":
            return F.avg(v.col.cast("double"))
        kind = LONG if isinstance(v.kind, T.IntegralType) else DOUBLE
        return F.coalesce(F.sum(v.col.cast(kind)), F.lit(0).cast(kind))
    return (F.min if node.op == "min" else F.max)(v.col)


def aggregate_type(node: Aggregate, env: Env) -> T.DataType:
    if node.op == "count":
        return LONG
    if node.op == "avg":
        return DOUBLE
    v = column(node.arg, env)
    if node.op == "sum":
        return LONG if isinstance(v.kind, T.IntegralType) else DOUBLE
    return v.kind
