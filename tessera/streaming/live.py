"""Live queries: run again when a commit touches what they read, delivered when their rows differ.

There is no incremental maintenance: a run is the whole batch query, which Catalyst plans. A query's
footprint, known before it runs, tells which commits matter; several commits before a flush cost one run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tessera.errors import TesseraError
from tessera.operators.query import Query
from tessera.sources.tables import RecordTable


def overlaps(footprint: set[tuple[str, str]], changes: set[tuple[str, str]]) -> bool:
    """Whether reads of (schema, attribute) meet changes; ``*`` stands for all."""
    return any((s in (c, "*") or c == "*") and (a in (b, "*") or b == "*") for s, a in footprint for c, b in changes)


def _digest(rows: list[dict], ordered: bool) -> str:
    """Equal rows have equal digests; their order counts only where the query gives one."""
    each = [json.dumps(r, default=str, sort_keys=True) for r in rows]
    return hashlib.sha256("\n".join(each if ordered else sorted(each)).encode()).hexdigest()


class LiveQuery:
    """Rows of a query, now and after changes."""

    _made = 0

    def __init__(self, build: Callable[[], Query], *, key: Callable[[Any], Column] | None = None, detach: Callable[[LiveQuery], None] = lambda _: None):
        self._build, self._key, self._detach = build, key, detach
        self._subscribers: list[Callable[[list[dict]], None]] = []
        self._dirty = False
        self._last: tuple[str, list[dict]] | None = None
        self.runs = 0
        LiveQuery._made += 1
        self.path = f"_live/{LiveQuery._made}"

    def frame(self) -> DataFrame:
        """The query as it stands, as a frame."""
        return self._build().run()

    def rows(self) -> list[dict]:
        return [r.asDict(True) for r in self.frame().collect()]

    def footprint(self) -> set[tuple[str, str]]:
        return self._build().footprint()

    def subscribe(self, callback: Callable[[list[dict]], None]) -> Callable[[], None]:
        """Call back with the rows at once, and whenever they change. Returns what stops it."""
        self._subscribers.append(callback)
        if self._last is None:
            self._run()
        callback(self._last[1])

        def stop() -> None:
            if callback in self._subscribers:
                self._subscribers.remove(callback)
            if not self._subscribers:
                self._last = None

        return stop

    def touch(self, changes: set[tuple[str, str]]) -> None:
        if self._subscribers and overlaps(self.footprint(), changes):
            self._dirty = True

    def flush(self) -> None:
        if not self._dirty or not self._subscribers:
            return
        self._dirty = False
        before = self._last[0] if self._last else None
        self._run()
        if self._last[0] != before:
            for callback in list(self._subscribers):
                callback(self._last[1])

    def _run(self) -> None:
        self.runs += 1
        rows = self.rows()
        self._last = (_digest(rows, bool(self._build().orders)), rows)

    def close(self) -> None:
        self._subscribers.clear()
        self._detach(self)

    def record_table(self) -> RecordTable:
        """The rows as records of ``_live/<number>``: keyed by the given key, else by ``id``, else by position.

        Of rows with one key one stays. Positions are stable only while the rows are.
        """
        from tessera.plans.builder import Row

        df = self.frame()
        if self._key is not None:
            own = self._key(Row({c: F.col(f"`{c}`") for c in df.columns}))
            return RecordTable(self.path, df.withColumn("id", own.cast("string")).dropDuplicates(["id"]))
        if "id" in df.columns:
            return RecordTable(self.path, df.withColumn("id", F.col("id").cast("string")).dropDuplicates(["id"]))
        return RecordTable(self.path, df, F.monotonically_increasing_id().cast("string"), keyless=True)


class LiveHandle:
    """What a user interface needs of a live query: its rows, and whether they are there."""

    def __init__(self, live: LiveQuery):
        self.rows: list[dict] = []
        self.status, self.error = "loading", None
        try:
            self._stop = live.subscribe(self._see)
        except Exception as e:
            self.status, self.error, self._stop = "error", e, lambda: None

    def _see(self, rows: list[dict]) -> None:
        self.rows, self.status = rows, "ready"

    def close(self) -> None:
        self._stop()
        self.status = "cleaned-up"


class LiveCollection:
    """A live query's rows as a read-only collection."""

    def __init__(self, live: LiveQuery):
        self.live, self.path, self.status = live, live.path, "ready"

    def record_table(self) -> RecordTable:
        return self.live.record_table()

    def items(self) -> list[dict]:
        return [{k: v for k, v in r.asDict(True).items() if v is not None} for r in self.record_table().records().collect()]

    def get(self, own: str) -> dict | None:
        rows = self.record_table().records().where(F.col("id") == own).collect()
        return {k: v for k, v in rows[0].asDict(True).items() if v is not None} if rows else None

    def keys(self) -> list[str]:
        return [r.id for r in self.record_table().records().select("id").collect()]

    @property
    def size(self) -> int:
        return self.record_table().records().count()

    def subscribe_changes(self, callback: Callable[[list[tuple[str, str, dict | None]]], None]) -> Callable[[], None]:
        """Call back with (insert, update or delete, key, row) whenever rows change."""
        known: dict[str, dict] = {}

        def see(_: list[dict]) -> None:
            now = {x["id"]: x for x in self.items()}
            changes = [("update" if k in known else "insert", k, x) for k, x in now.items() if known.get(k) != x]
            changes += [("delete", k, None) for k in known if k not in now]
            known.clear()
            known.update(now)
            if changes:
                callback(changes)

        return self.live.subscribe(see)

    def _refuse(self, *_: Any) -> None:
        raise TesseraError("UNSUPPORTED", "the rows of a live query cannot be written")

    insert = update = delete = _refuse
