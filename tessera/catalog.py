"""Schema definitions, their modes, and how writes are held against them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T
from tessera.errors import TesseraError
from tessera.values import TYPES, coerce, infer, infer_items, spark_type, type_name

MODES = ("strict", "flexible", "dynamic")


@dataclass(frozen=True)
class FieldDef:
    """A declared attribute."""

    type: str
    items: str | None = None
    required: bool = False

    def __post_init__(self):
        if self.type not in TYPES:
            raise TesseraError("SCHEMA_VIOLATION", f"no type {self.type}")


@dataclass(frozen=True)
class Def:
    """A schema: strict refuses undeclared attributes, flexible stores them, dynamic declares them."""

    ns: str
    schema: str
    mode: str = "dynamic"
    fields: dict[str, FieldDef] = field(default_factory=dict)

    @property
    def path(self) -> str:
        return f"{self.ns}/{self.schema}"

    def to_json(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_json(data: dict[str, Any]) -> Def:
        return Def(data["ns"], data["schema"], data["mode"], {k: FieldDef(**v) for k, v in data["fields"].items()})

    def struct(self) -> T.StructType:
        """The wide table's type: an id and the declared attributes."""
        own = [T.StructField(k, spark_type(f.type, f.items), not f.required) for k, f in self.fields.items()]
        return T.StructType([T.StructField("id", T.StringType(), False), *own])


def def_of(path: str, struct: T.StructType | None = None, *, mode: str | None = None, types: dict[str, FieldDef] | None = None) -> Def:
    """A definition from a Spark struct: strict with one, dynamic without. Nested structs become dotted names."""
    ns, schema = path.split("/")
    fields: dict[str, FieldDef] = {}

    def walk(prefix: str, struct: T.StructType, optional: bool) -> None:
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                walk(f"{prefix}{f.name}.", f.dataType, optional or f.nullable)
            elif prefix or f.name != "id":
                kind, items = type_name(f.dataType)
                fields[prefix + f.name] = FieldDef(kind, items, not f.nullable and not optional)

    if struct is not None:
        walk("", struct, False)
    return Def(ns, schema, mode or ("strict" if struct is not None else "dynamic"), fields | (types or {}))


def enforce(schema: Def | None, attrs: dict[str, Any], *, whole: bool, path: str) -> tuple[dict[str, Any], Def | None]:
    """Attributes as the schema takes them, and the schema they leave (a dynamic one may grow).

    ``whole`` tells that the write makes up a whole record, which must have all required attributes.
    """
    if schema is None:
        return attrs, None
    out, fields = {}, dict(schema.fields)
    for name, value in attrs.items():
        if name.startswith("_"):
            out[name] = value
            continue
        own = fields.get(name)
        if own is None and schema.mode == "strict":
            raise TesseraError("SCHEMA_VIOLATION", f"{name} is not declared in {schema.path}", uri=path, issues=[{"path": name, "message": "not declared"}])
        if own is None and schema.mode == "dynamic" and value is not None:
            kind = infer(value)
            own = fields[name] = FieldDef(kind, infer_items(list(value)) if kind == "array" else None)
        if own is None:
            out[name] = value
            continue
        try:
            out[name] = coerce(value, own.type, own.items)
        except TesseraError as e:
            raise TesseraError("SCHEMA_VIOLATION", f"{name}: {e.message}", uri=path, issues=[{"path": name, "message": e.message}]) from None
    if whole:
        for name, own in fields.items():
            if own.required and name not in out:
                raise TesseraError("SCHEMA_VIOLATION", f"{name} is required in {schema.path}", uri=path, issues=[{"path": name, "message": "required"}])
    return out, replace(schema, fields=fields) if fields != schema.fields else schema


def refuse_removal(schema: Def | None, names: list[str], path: str) -> None:
    """Required attributes cannot be deleted."""
    for name in names:
        if schema is not None and name in schema.fields and schema.fields[name].required:
            raise TesseraError("SCHEMA_VIOLATION", f"{name} is required in {schema.path}", uri=path)
