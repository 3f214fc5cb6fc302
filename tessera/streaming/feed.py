"""The change feed as Structured Streaming: an append-only log of events, watched and replayed.

Each commit appends one file of events, numbered after the log's last one, also by a process that comes later. A stream over the log is filtered by scope; ``run_live`` re-runs
a query in ``foreachBatch`` when a batch meets its footprint. Row-level feeds fold the log by record with
the latest version, batch or streaming alike.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tessera.streaming.live import overlaps

EVENTS = "seq long, type string, path string, schema string, attrs array<string>, version long"


class ChangeLog:
    """A folder of change events that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seq = spark, folder.rstrip("/"), None

    def attach(self, store: Any, scope: str) -> Callable[[], None]:
        """Log every commit of a store in a scope. One process at a time writes a log."""
        return store.watch_commits(scope, self.append)

    def _last(self) -> int:
        """The number of the last event that is logged."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self.replay().agg(F.max("seq")).first()[0] or 0

    def append(self, events: list[Any]) -> None:
        rows = []
        if self._seq is None:
            self._seq = self._last()
        for e in events:
            self._seq += 1
            rows.append((self._seq, e.type, e.path, "/".join(e.path.split("/")[:2]), list(e.attrs), e.version))
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self, scope: str | None = None) -> DataFrame:
        """The log as a stream, cut to a scope."""
        return scoped(self.spark.readStream.schema(EVENTS).parquet(self.folder), scope)

    def replay(self, scope: str | None = None) -> DataFrame:
        """The log so far, as a batch."""
        return scoped(self.spark.read.schema(EVENTS).parquet(self.folder), scope)


def scoped(events: DataFrame, scope: str | None) -> DataFrame:
    if scope is None:
        return events
    inside: Column = (F.col("path") == scope) | F.startswith("path", F.lit(scope + "/"))
    return events.where(inside)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each record; on a stream, with update or complete output."""
    return events.groupBy("path").agg(F.max_by("type", "seq").alias("type"), F.max_by("version", "seq").alias("version"), F.count("*").alias("changes"))


def run_live(stream: DataFrame, footprint: set[tuple[str, str]], rerun: Callable[[], None], checkpoint: str):
    """Process what the log has by now; ``rerun`` is called for each batch that meets the footprint."""

    def each(batch: DataFrame, _: int) -> None:
        keys = batch.select("schema", F.explode(F.array_append("attrs", "_id")).alias("attr")).distinct()
        wanted = {s for s, _ in footprint} - {"*"}
        if wanted:
            keys = keys.where(F.col("schema").isin(sorted(wanted)))
        if overlaps(footprint, {(r.schema, r.attr) for r in keys.collect()}):
            rerun()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
