"""Reads of whole records: one by id, pages by a deterministic order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tessera.plans.builder import Row
from tessera.sources.tables import RecordTable

DEFAULT_LIMIT, MOST_LIMIT = 20, 1000


@dataclass(frozen=True)
class Page:
    """Records of a page as a frame, the number of all matches, and where the next page starts (0: nowhere)."""

    frame: DataFrame
    total: int
    next_offset: int

    @property
    def items(self) -> list[dict]:
        return [{k: v for k, v in r.asDict(True).items() if v is not None} for r in self.frame.collect()]


def get_record(table: RecordTable, own_id: str) -> DataFrame:
    """The record of an id, as a frame of at most one row."""
    return table.records().where(F.col("id") == own_id)


def list_records(table: RecordTable, *, test: Callable[[Row], Column] | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> Page:
    """A page of records in the order of their ids. ``limit`` is cut to MOST_LIMIT."""
    rows = table.records()
    if test is not None:
        rows = rows.where(test(Row({c: F.col(f"`{c}`") for c in rows.columns})))
    limit = min(limit, MOST_LIMIT)
    total = rows.count()
    after = offset + limit
    return Page(rows.orderBy("id").offset(offset).limit(limit), total, after if after < total else 0)
