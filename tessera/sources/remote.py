"""A remote change feed as a streaming source: ``spark.readStream.format("tessera_watch")``.

The option ``client`` names a function (``module:function``) that executors can import. It is called with
the options and the last sequence number, and gives events after it as (seq, type, path, attrs, version).
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from tessera.streaming.feed import EVENTS


class RemoteWatch(DataSource):
    """Register with ``spark.dataSource.register(RemoteWatch)``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_watch"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
        return RemoteReader(dict(self.options))


class RemoteReader(SimpleDataSourceStreamReader):
    """Events by sequence number; what was read once can be read again."""

    def __init__(self, options: dict[str, str]):
        module, _, function = options["client"].partition(":")
        self.options, self.client = options, getattr(importlib.import_module(module), function)

    def initialOffset(self) -> dict:
        return {"seq": int(self.options.get("from", 0))}

    def _rows(self, after: int) -> list[tuple]:
        found = sorted(self.client(self.options, after))
        return [(seq, kind, path, "/".join(path.split("/")[:2]), list(attrs), version) for seq, kind, path, attrs, version in found]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["seq"])
        return iter(rows), {"seq": rows[-1][0] if rows else start["seq"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in self._rows(start["seq"]) if r[0] <= end["seq"]])
