"""Records between nested objects and flat tuples: dicts fold to dotted attributes, everything else is a leaf."""

from __future__ import annotations

from typing import Any

from tessera.values import MISSING


def attributes(item: dict[str, Any]) -> dict[str, Any]:
    """Dotted attributes of an object; the top-level ``id`` and missing leaves are left out."""
    out: dict[str, Any] = {}

    def walk(prefix: str, value: Any) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{prefix}.{k}", v)
        elif value is not MISSING:
            out[prefix] = value

    for k, v in item.items():
        if k != "id":
            walk(k, v)
    return out


def item(attrs: dict[str, Any], *, system: bool = False) -> dict[str, Any]:
    """The nested object of attributes; ``_id`` becomes ``id``, other system attributes only on request."""
    out: dict[str, Any] = {}
    for name, value in attrs.items():
        if name == "_id":
            out["id"] = value
        elif not name.startswith("_") or system:
            put_in(out, name, value)
    return out


def get_in(obj: dict[str, Any], name: str) -> Any:
    at: Any = obj
    for part in name.split("."):
        if not isinstance(at, dict) or part not in at:
            return MISSING
        at = at[part]
    return at


def put_in(obj: dict[str, Any], name: str, value: Any) -> None:
    *parents, leaf = name.split(".")
    for part in parents:
        if not isinstance(obj.get(part), dict):
            obj[part] = {}
        obj = obj[part]
    obj[leaf] = value
