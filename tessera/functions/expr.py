"""Expression and aggregate nodes, built by plain functions over field references.

``ref`` objects come from the query builder: ``post.title`` or ``post["author.name"]`` names a field.
Nodes are plain data; ``tessera.plans.columns`` turns them into Spark columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from tessera.errors import TesseraError


@dataclass(frozen=True)
class Field:
    """A field of one alias of a query."""

    alias: str
    name: str


@dataclass(frozen=True)
class Expr:
    """A scalar expression: an operator and its arguments (nodes, fields or literals)."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    """An aggregate over the rows of a group."""

    op: str
    arg: Any = None


class Ref:
    """What a query's callbacks get for an alias: its attributes and items are fields."""

    def __init__(self, alias: str):
        object.__setattr__(self, "_alias", alias)

    def __getattr__(self, name: str) -> Field:
        if name.startswith("__"):
            raise AttributeError(name)
        return Field(self._alias, name)

    def __getitem__(self, name: str) -> Field:
        return Field(self._alias, name)


class Refs(dict):
    """References of all aliases, by attribute or by key."""

    def __getattr__(self, name: str) -> Ref:
        try:
            return self[name]
        except KeyError:
            raise TesseraError("INVALID_QUERY", f"the query has no alias {name}") from None


def _node(op: str, *args: Any) -> Expr:
    return Expr(op, args)


def eq(a: Any, b: Any) -> Expr:
    return _node("eq", a, b)


def ne(a: Any, b: Any) -> Expr:
    return _node("ne", a, b)


def gt(a: Any, b: Any) -> Expr:
    return _node("gt", a, b)


def gte(a: Any, b: Any) -> Expr:
    return _node("gte", a, b)


def lt(a: Any, b: Any) -> Expr:
    return _node("lt", a, b)


def lte(a: Any, b: Any) -> Expr:
    return _node("lte", a, b)


def and_(*args: Any) -> Expr:
    return _node("and", *args)


def or_(*args: Any) -> Expr:
    return _node("or", *args)


def not_(a: Any) -> Expr:
    return _node("not", a)


def in_array(needle: Any, array: Any) -> Expr:
    return _node("in_array", needle, tuple(array) if isinstance(array, (list, tuple)) else array)


def like(a: Any, pattern: Any) -> Expr:
    return _node("like", a, pattern)


def ilike(a: Any, pattern: Any) -> Expr:
    return _node("ilike", a, pattern)


def starts_with(a: Any, prefix: Any) -> Expr:
    return _node("starts_with", a, prefix)


def ends_with(a: Any, suffix: Any) -> Expr:
    return _node("ends_with", a, suffix)


def is_undefined(a: Any) -> Expr:
    return _node("is_undefined", a)


def is_null(a: Any) -> Expr:
    return _node("is_null", a)


def length(a: Any) -> Expr:
    return _node("length", a)


def upper(a: Any) -> Expr:
    return _node("upper", a)


def lower(a: Any) -> Expr:
    return _node("lower", a)


def concat(*args: Any) -> Expr:
    return _node("concat", *args)


def add(a: Any, b: Any) -> Expr:
    return _node("add", a, b)


def subtract(a: Any, b: Any) -> Expr:
    return _node("subtract", a, b)


def multiply(a: Any, b: Any) -> Expr:
    return _node("multiply", a, b)


def divide(a: Any, b: Any) -> Expr:
    return _node("divide", a, b)


def coalesce(*args: Any) -> Expr:
    return _node("coalesce", *args)


def case_when(condition: Any, then: Any, otherwise: Any = None) -> Expr:
    return _node("case_when", condition, then, otherwise)


def count(arg: Any = None) -> Aggregate:
    return Aggregate("count", arg)


def sum_(arg: Any) -> Aggregate:
    return Aggregate("sum", arg)


def avg(arg: Any) -> Aggregate:
    return Aggregate("avg", arg)


def min_(arg: Any) -> Aggregate:
    return Aggregate("min", arg)


def max_(arg: Any) -> Aggregate:
    return Aggregate("max", arg)


def children(node: Any) -> tuple:
    if isinstance(node, Expr):
        return node.args
    if isinstance(node, Aggregate):
        return () if node.arg is None else (node.arg,)
    if isinstance(node, dict):
        return tuple(node.values())
    if isinstance(node, (list, tuple)):
        return tuple(node)
    return ()


def fields(node: Any) -> Iterator[Field]:
    """All fields that a template reads."""
    if isinstance(node, Field):
        yield node
    for child in children(node):
        yield from fields(child)


def required_fields(node: Any) -> Iterator[Field]:
    """Fields that a condition needs to be present: all but direct arguments of is_undefined."""
    if isinstance(node, Field):
        yield node
    elif isinstance(node, Expr) and node.op == "is_undefined":
        for arg in node.args:
            if not isinstance(arg, Field):
                yield from required_fields(arg)
    else:
        for child in children(node):
            yield from required_fields(child)


def aggregates(node: Any) -> Iterator[Aggregate]:
    """All aggregates of a template; one inside another is refused."""
    if isinstance(node, Aggregate):
        if any(True for _ in aggregates(node.arg)):
            raise TesseraError("INVALID_QUERY", "an aggregate cannot hold an aggregate")
        yield node
        return
    for child in children(node):
        yield from aggregates(child)
