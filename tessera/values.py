"""Values of tuples: their nine types, inference, coercion, equality keys and storage text."""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable
from datetime import UTC, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T
from tessera.errors import TesseraError

TYPES = ("string", "integer", "unsigned", "float", "boolean", "time", "bytes", "json", "array")
_INTEGER = re.compile(r"[+-]?\d+")


class Missing:
    """The absence of a value, which is not null."""

    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False


MISSING = Missing()


def millis(value: datetime) -> int:
    value = value if value.tzinfo else value.replace(tzinfo=UTC)
    return round(value.timestamp() * 1000)


def infer(value: Any) -> str:
    """The type of a value; a float without a fraction is an integer. Null has none."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, (float, Decimal)):
        return "integer" if math.isfinite(value) and value == int(value) else "float"
    if isinstance(value, datetime):
        return "time"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, (list, tuple)):
        return "array"
    if isinstance(value, dict):
        return "json"
    raise TesseraError("SCHEMA_VIOLATION", f"no type can be told for {value!r}")


def infer_items(values: list[Any]) -> str:
    """The common type of an array's elements; json if they differ or there are none."""
    kinds = {"json" if v is None else infer(v) for v in values}
    return kinds.pop() if len(kinds) == 1 else "json"


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def _whole(value: Any) -> int | None:
    if _is_number(value):
        return int(value) if math.isfinite(value) and value == int(value) else None
    return int(value) if isinstance(value, str) and _INTEGER.fullmatch(value.strip()) else None


def _not_negative(value: Any) -> int | None:
    found = _whole(value)
    return found if found is not None and found >= 0 else None


def _real(value: Any) -> float | None:
    if not _is_number(value) and not (isinstance(value, str) and value.strip()):
        return None
    try:
        return float(value)
    except ValueError:
        return None


def _moment(value: Any) -> datetime | None:
    if _is_number(value):
        return datetime.fromtimestamp(value / 1000, UTC) if math.isfinite(value) else None
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            return None
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    return value if isinstance(value, datetime) else None


#: How each type takes a value; None where it does not.
_TAKES: dict[str, Callable[[Any], Any]] = {
    "string": lambda v: v if isinstance(v, str) else None,
    "integer": _whole,
    "unsigned": _not_negative,
    "float": _real,
    "boolean": lambda v: v if isinstance(v, bool) else None,
    "time": _moment,
    "bytes": lambda v: bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else None,
    "json": lambda v: v if is_json(v) else None,
}


def coerce(value: Any, kind: str, items: str | None = None) -> Any:
    """The value as a declared type takes it; raises SCHEMA_VIOLATION otherwise. Null fits any type."""
    if value is None:
        return None
    if kind == "array" and isinstance(value, (list, tuple)):
        return [coerce(v, items or infer_items(list(value))) for v in value]
    found = _TAKES[kind](value) if kind in _TAKES else None
    if found is None:
        raise TesseraError("SCHEMA_VIOLATION", f"{value!r} is not of type {kind}")
    return found


def is_json(value: Any) -> bool:
    if value is None or isinstance(value, (str, bool, int)):
        return True
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, (list, tuple)):
        return all(is_json(v) for v in value)
    return isinstance(value, dict) and all(isinstance(k, str) and is_json(v) for k, v in value.items())


#: What the equality keys of each kind of value begin with; numbers of all kinds and times share one.
ABSENT, NULL, TEXT, NUMBER, FLAG, BYTES, LIST, OBJECT = "missing", "null", "text=", "number=", "flag=", "bytes=", "list=", "object="


def _number_key(value: Any) -> str:
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return str(int(value)) if math.isfinite(value) and value == int(value) else repr(float(value))


#: Kinds of values with their keys; the first that fits counts.
_KEYS: tuple[tuple[tuple[type, ...], str, Callable[[Any], str]], ...] = (
    ((Missing,), ABSENT, lambda v: ""),
    ((type(None),), NULL, lambda v: ""),
    ((bool,), FLAG, lambda v: str(v).lower()),
    ((str,), TEXT, str),
    ((int, float, Decimal), NUMBER, _number_key),
    ((datetime,), NUMBER, lambda v: str(millis(v))),
    ((bytes, bytearray), BYTES, lambda v: bytes(v).hex()),
    ((list, tuple), LIST, lambda v: json.dumps([key(x) for x in v])),
    ((object,), OBJECT, lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), default=key)),
)


def key(value: Any) -> str:
    """Equal values, and only those, have equal keys."""
    return next(tag + make(value) for kinds, tag, make in _KEYS if isinstance(value, kinds))


def same(a: Any, b: Any) -> bool:
    return key(a) == key(b)


def to_text(value: Any) -> tuple[str, str | None]:
    """A value's type and storage text."""
    if value is None:
        return "null", None
    kind = infer(value)
    if kind == "string":
        return kind, value
    if kind == "integer":
        return kind, str(int(value))
    if kind == "float":
        return kind, repr(float(value))
    if kind == "boolean":
        return kind, "true" if value else "false"
    if kind == "time":
        return kind, (value if value.tzinfo else value.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
    if kind == "bytes":
        return kind, base64.b64encode(value).decode()
    if kind == "array":
        return kind, json.dumps([to_text(v) for v in value])
    return kind, json.dumps(value, sort_keys=True)


def from_text(kind: str, text: str | None) -> Any:
    """The value of a storage text."""
    if kind == "null" or text is None:
        return None
    if kind in ("integer", "unsigned"):
        return int(text)
    if kind == "float":
        return float(text)
    if kind == "boolean":
        return text == "true"
    if kind == "time":
        return datetime.fromisoformat(text)
    if kind == "bytes":
        return base64.b64decode(text)
    if kind == "array":
        return [from_text(k, t) for k, t in json.loads(text)]
    if kind == "json":
        return json.loads(text)
    return text


#: Spark's type of each value type.
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "unsigned": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "time": T.TimestampType(),
    "bytes": T.BinaryType(),
    "json": T.StringType(),
}


def spark_type(kind: str, items: str | None = None) -> T.DataType:
    return T.ArrayType(SPARK_TYPES.get(items or "json", T.StringType())) if kind == "array" else SPARK_TYPES[kind]


def type_name(kind: T.DataType) -> tuple[str, str | None]:
    """The value type of a Spark type, and an array's item type."""
    if isinstance(kind, T.ArrayType):
        return "array", type_name(kind.elementType)[0]
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string", None
    if isinstance(kind, T.IntegralType):
        return "integer", None
    if isinstance(kind, T.BooleanType):
        return "boolean", None
    if isinstance(kind, T.NumericType):
        return "float", None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time", None
    if isinstance(kind, T.BinaryType):
        return "bytes", None
    return "json", None
