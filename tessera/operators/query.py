"""The fluent query builder. Every call returns a new query; nothing runs before an action on the result.

Callbacks get references to the aliases (``lambda r: eq(r.post.author, r.user.id)``). Stages run in this
order, however they are called: joins and conditions, ``fn_where``, grouping, projection, ``having``,
``fn_having``, ``distinct``, ``order_by``, ``offset``, ``limit``, ``fn_select``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from tessera.errors import TesseraError
from tessera.functions.expr import Expr, Field, Ref, Refs
from tessera.sources.tables import RecordTable


@dataclass(frozen=True)
class Source:
    """An aliased source and how it joins to those before it."""

    alias: str
    table: Any
    kind: str  # from, inner, left, right, full


@dataclass(frozen=True)
class Query:
    """A query, as data."""

    sources: tuple[Source, ...] = ()
    conditions: tuple[Any, ...] = ()
    projection: Callable | None = None
    keys: Callable | None = None
    having_: tuple[Callable, ...] = ()
    distinct_: bool = False
    orders: tuple[tuple[Callable, bool], ...] = ()
    offset_: int = 0
    limit_: int | None = None
    fn_wheres: tuple[Callable, ...] = ()
    fn_havings: tuple[Callable, ...] = ()
    fn_selects: tuple[Callable, ...] = field(default=())

    def refs(self) -> Refs:
        return Refs({s.alias: Ref(s.alias) for s in self.sources})

    def _with(self, sources: dict[str, Any], kind: str) -> Query:
        taken = {s.alias for s in self.sources}
        for alias in sources:
            if alias in taken:
                raise TesseraError("INVALID_QUERY", f"the alias {alias} is used twice")
        return replace(self, sources=self.sources + tuple(Source(a, t, kind) for a, t in sources.items()))

    def from_(self, **sources: Any) -> Query:
        """Sources under aliases; several make a cross product unless conditions equate them."""
        return self._with(sources, "from")

    def join(self, on: Callable[[Refs], Any], kind: str = "left", **sources: Any) -> Query:
        """Join sources; by default a left join."""
        if kind not in ("inner", "left", "right", "full"):
            raise TesseraError("INVALID_QUERY", f"no join kind {kind}")
        joined = self._with(sources, kind)
        return joined.where(on)

    def inner_join(self, on: Callable[[Refs], Any], **sources: Any) -> Query:
        return self.join(on, "inner", **sources)

    def left_join(self, on: Callable[[Refs], Any], **sources: Any) -> Query:
        return self.join(on, "left", **sources)

    def right_join(self, on: Callable[[Refs], Any], **sources: Any) -> Query:
        return self.join(on, "right", **sources)

    def full_join(self, on: Callable[[Refs], Any], **sources: Any) -> Query:
        return self.join(on, "full", **sources)

    def where(self, condition: Callable[[Refs], Any]) -> Query:
        """A condition, in conjunction with all others."""
        return replace(self, conditions=(*self.conditions, *_conjuncts(condition(self.refs()))))

    def select(self, projection: Callable[[Refs], Any]) -> Query:
        """The row's template: a dict (nested ones make structs), a list, or one field (column ``value``)."""
        return replace(self, projection=projection)

    def group_by(self, keys: Callable[[Refs], Any]) -> Query:
        return replace(self, keys=keys)

    def having(self, condition: Callable[[Refs], Any]) -> Query:
        return replace(self, having_=(*self.having_, condition))

    def distinct(self) -> Query:
        return replace(self, distinct_=True)

    def order_by(self, key: Callable[[Refs], Any], direction: str = "asc") -> Query:
        """A sort key, after those before it. What no key tells apart is in the order of the first source's ids."""
        if direction not in ("asc", "desc"):
            raise TesseraError("INVALID_QUERY", f"no direction {direction}")
        return replace(self, orders=(*self.orders, (key, direction == "desc")))

    def offset(self, n: int) -> Query:
        return replace(self, offset_=n)

    def limit(self, n: int) -> Query:
        return replace(self, limit_=n)

    def fn_where(self, test: Callable) -> Query:
        """A test of joined records as a Spark column: ``lambda row: row.post.views % 2 == 0``, or ``in_python(...)``."""
        return replace(self, fn_wheres=(*self.fn_wheres, test))

    def fn_having(self, test: Callable) -> Query:
        """A test of projected rows as a Spark column, or ``in_python(...)``."""
        return replace(self, fn_havings=(*self.fn_havings, test))

    def fn_select(self, projection: Callable) -> Query:
        """A last projection: from the row's columns to a dict of columns, or ``in_python(..., type)``."""
        return replace(self, fn_selects=(*self.fn_selects, projection))

    def run(self) -> DataFrame:
        """The query as a DataFrame."""
        from tessera.plans.builder import plan

        return plan(self)

    def footprint(self) -> set[tuple[str, str]]:
        """The (schema path, attribute) pairs that the query reads; ``*`` for whole records."""
        from tessera.plans.builder import footprint

        return footprint(self)


def query() -> Query:
    return Query()


def _conjuncts(node: Any) -> list[Any]:
    if isinstance(node, Expr) and node.op == "and":
        return [x for a in node.args for x in _conjuncts(a)]
    if not isinstance(node, (Expr, Field, bool)):
        raise TesseraError("INVALID_QUERY", f"{node!r} is no condition")
    return [node]


def table_of(source: Any) -> RecordTable:
    """The record table behind a source: a table, or anything with a ``records()`` method that gives one."""
    if isinstance(source, RecordTable):
        return source
    if hasattr(source, "record_table"):
        return source.record_table()
    raise TesseraError("INVALID_QUERY", f"{source!r} is no source of records")
