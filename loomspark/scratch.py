"""Tables that are read more than once, written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of each local application whose session names none.
_OWN: dict[str, str] = {}
#: Paths of the tables written since the innermost temporary_tables() began.
_OPEN: ContextVar[list[str] | None] = ContextVar("loomspark_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's settings name it. A local session that names none, as in
    tests, gets a new local one, the same for as long as the application runs; on a cluster, whose executors wouldn't
    see it, that is an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _OWN.get(context.applicationId)
    if not at:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there when an executor is lost. It stays
    until discard(), or until the temporary_tables() around the call ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (paths := _OPEN.get()) is not None:
        paths.append(path)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go as soon as it ends, not when the driver's memory is next collected: the table
    stands for them from then on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what written() wrote within it. The result must be written, or collected, before that."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        paths = _OPEN.get() or []
        _OPEN.reset(token)
        for path in paths:
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that written() made; df isn't readable any more."""
    path = getattr(df, "_written_at", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
