"""Index-like reads over record tables, as frames of tuples: by record, by attribute, by value, by scope.

There is no index structure: each read is a filter on the wide table, which partition pruning and Parquet
statistics serve. Only reads by value alone look at every attribute.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tessera.errors import TesseraError
from tessera.plans.columns import literal
from tessera.sources.tables import NULLS, RecordTable, key_text, tuples
from tessera.uri import id_of, parse, schema_of
from tessera.values import NULL


class TupleIndex:
    """Tuples (path, ns, schema, id, attr, text, key) of some tables."""

    def __init__(self, tables: Iterable[RecordTable]):
        self.tables = {t.path: t for t in tables}

    def _table(self, path: str) -> RecordTable:
        if path not in self.tables:
            raise TesseraError("NOT_FOUND", f"no table {path}", uri=path)
        return self.tables[path]

    def _some(self, tables: list[RecordTable]) -> DataFrame:
        if not tables:
            raise TesseraError("NOT_FOUND", "no table in this scope")
        return reduce(DataFrame.unionByName, [tuples(t) for t in tables])

    def attrs(self, path: str) -> DataFrame:
        """All tuples of a record."""
        t = self._table(schema_of(path))
        own = RecordTable(t.path, t.df.where(t.id() == id_of(path)), t.key)
        return tuples(own)

    def get(self, path: str, attr: str) -> DataFrame:
        """One tuple of a record."""
        return self.attrs(path).where(F.col("attr") == attr)

    def has(self, path: str) -> bool:
        """Whether a record exists."""
        t = self._table(schema_of(path))
        return not t.df.where(t.id() == id_of(path)).isEmpty()

    def by_schema_attr(self, path: str, attr: str) -> DataFrame:
        """One attribute of all records of a schema, read as one column."""
        t = self._table(path)
        if t.kind(attr) is None:
            return tuples(t).limit(0)
        if attr in ("id", "_id"):
            return tuples(t).where(F.col("attr") == "_id")
        frame = t.records()
        one = frame.select("id", F.col(f"`{attr}`"), *([NULLS] if t.has_nulls else []))
        return tuples(RecordTable(t.path, one), system=False)

    def by_value(self, value: Any) -> DataFrame:
        """Tuples of any record that hold a value."""
        v = literal(value)
        return self.all().where(F.col("key") == (F.lit(NULL) if value is None else key_text(v.col, v.kind)))

    def by_schema(self, path: str) -> DataFrame:
        return tuples(self._table(path))

    def scan(self, scope: str) -> DataFrame:
        """Tuples of a namespace, schema or record."""
        u = parse(scope)
        if u.id is not None:
            return self.attrs(u.path)
        return self._some([t for p, t in self.tables.items() if p == u.path or (u.schema is None and p.split("/")[0] == u.ns)])

    def all(self) -> DataFrame:
        return self._some(list(self.tables.values()))

    def paths(self, scope: str) -> DataFrame:
        """Paths of the records in a scope."""
        u = parse(scope)
        own = [t for p, t in self.tables.items() if p == "/".join(u.path.split("/")[:2]) or (u.schema is None and p.split("/")[0] == u.ns)]
        frames = [t.df.select(F.concat(F.lit(t.path + "/"), t.id()).alias("path")) for t in own]
        if not frames:
            raise TesseraError("NOT_FOUND", "no table in this scope")
        out = reduce(DataFrame.unionByName, frames)
        return out.where(F.col("path") == u.path) if u.id is not None else out
