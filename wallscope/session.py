"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SCRATCH_SETTING = "spark.checkpoint.dir"


def build_session(app_name: str = "wallscope", **settings: str) -> SparkSession:
    """A session with the settings this package is planned for.

    Master, memory and partition counts stay with the deployment (spark-submit).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine: on
    a cluster the executors would not see each other's files.
    """
    root = spark.conf.get(SCRATCH_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {SCRATCH_SETTING} to a folder that all executors share")
    return _local_root()


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="wallscope-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    created = _created.get()
    if created is not None:
        created.append(path)
    return path


_created: ContextVar[list[str] | None] = ContextVar("created", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside once the block is left.

    For jobs that write their result: what they return no longer needs them.
    """
    created: list[str] = []
    token = _created.set(created)
    try:
        yield
    finally:
        _created.reset(token)
        for path in created:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing needs any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put the folder ``source`` in the place of ``target``; where it doesn't exist nothing is left there."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(target).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(paths(target), True)
    if files.exists(paths(source)):
        files.mkdirs(paths(target).getParent())
        if not files.rename(paths(source), paths(target)):
            raise OSError(f"can't move {source} to {target}")


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors cost a re-read, not a recomputation, and
    every consumer reads only the columns it needs, with true size statistics.
    With ``by`` there is a folder for each of the few values of that column, and
    who filters on it reads only these.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
