"""Written intermediate tables: they cut lineage, and executors may come and go between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Drops the shuffle files of a statement when it ends: those behind a written table are not read again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []
_scopes: list[list[tuple[SparkSession, str]]] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster is refused, as a
    machine-local folder there would be invisible to the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; removed when the driver's Python ends."""
    path = f"{folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    (_scopes[-1] if _scopes else _made).append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def table_at(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at path; one without rows where a stream that had nothing to read has written none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def drop(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    _delete(table.sparkSession, table._scratch)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the scratch tables that are written inside, but for those given to the yielded function, when it ends."""
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._scratch)
        return table

    _scopes.append([])
    try:
        yield keep
    finally:
        for spark, path in _scopes.pop():
            if path in kept:
                (_scopes[-1] if _scopes else _made).append((spark, path))
            else:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended already
            return
