"""Session helpers: shipping the package to executors and writing intermediate tables.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; it is shared by
driver and executors, so a lost executor never takes part of a table with it.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors.

    Read from ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder
    of its own; a cluster session is refused, since a machine-local folder would lose data there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = context.applicationId
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = tempfile.mkdtemp(prefix="tessera-")
    return _OWN_DIRS[key]


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _STAGED:
        try:
            _forget(spark, path)
        except Exception:  # the JVM may already be gone at interpreter exit
            return


atexit.register(_sweep)


#: Whether a finished query's shuffle files are deleted at once, and not when their plan is collected as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which cuts its lineage.

    Nothing reads the write's shuffle files afterwards, so they are deleted with it. The table's files are
    deleted when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame | None) -> None:
    """Delete staged tables that no later plan reads. Other frames are left alone."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path is not None:
            entry = (df.sparkSession, path)
            _forget(*entry)
            if entry in _STAGED:
                _STAGED.remove(entry)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once per application."""
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(key)
