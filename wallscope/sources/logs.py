"""Raw log files and parsed or enriched log tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

DEFAULT_PATTERN = "*.log*"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` exist on whatever file system it names?"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _is_directory(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
    return status.isDirectory()


def _matching_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Files of a directory that match ``pattern``, but for hidden ones."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    names = [status.getPath().toString() for status in found or [] if status.isFile()]
    return [name for name in names if name.rpartition("/")[2][0] not in "_."]


def read_lines(
    spark: SparkSession,
    path: str,
    pattern: str = DEFAULT_PATTERN,
    partitions: int | None = None,
) -> DataFrame:
    """Lines of one file, or of a directory's files that match ``pattern``.

    Sub-directories are not entered, ``.gz`` files are unpacked while reading. A
    gzip file cannot be split, so its lines are dealt anew before parsing, over
    ``partitions`` if given; lines of other files are never shuffled.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"log path not found: {path}")
    # A directly named file is read whatever it is called.
    names = _matching_files(spark, path, pattern) if _is_directory(spark, path) else [path]
    packed = [name for name in names if name.endswith(".gz")]
    plain = [name for name in names if not name.endswith(".gz")]
    if not names:
        return spark.createDataFrame([], "value string")
    parts = [spark.read.text(plain)] if plain else []
    if packed:
        lines = spark.read.text(packed)
        parts.append(lines.repartition(partitions) if partitions else lines.hint("rebalance"))
    return reduce(DataFrame.union, parts)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parsed, enriched or network table in Parquet."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"table not found: {path}")
    return spark.read.parquet(path)


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> None:
    """Write a log table as Parquet, optionally laid out by partition columns."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
