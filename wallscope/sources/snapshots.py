"""Versions of a folder: complete snapshots, and a log of which is current.

A snapshot is written to a folder of its own and becomes current by one small file,
``versions/<number>``, which is made last and names it. Readers take the highest number, so
they see all of a version or none of it; who reads an older one goes on undisturbed. The
file is created exclusively: of two writers that got the same number one has to begin anew.
All of this goes through Hadoop's file systems.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

LOG, DATA = "versions", "snapshots"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small text file; False if there is one already."""
    target, files = _path(spark, path)
    if files.exists(target):
        return False
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it isn't there."""
    target, files = _path(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, also of those whose file isn't complete yet."""
    target, files = _path(spark, f"{path}/{LOG}")
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    return sorted(int(name) for name in names if name.isdigit())


def folder(spark: SparkSession, path: str, version: int) -> str | None:
    """Where a version lies; None if there is no such version or its file isn't complete."""
    name = read(spark, f"{path}/{LOG}/{version:012d}")
    return f"{path}/{DATA}/{name}" if name else None


def current(spark: SparkSession, path: str) -> int | None:
    """The number of the newest complete version."""
    for version in reversed(versions(spark, path)):
        if folder(spark, path, version):
            return version
    return None


def new_folder(path: str) -> tuple[str, str]:
    """Name and place for the data of a version to come."""
    name = uuid.uuid4().hex
    return name, f"{path}/{DATA}/{name}"


def commit(spark: SparkSession, path: str, after: int | None, name: str) -> int | None:
    """Make a written snapshot current if ``after`` still is; None if another version came first."""
    if current(spark, path) != after:
        return None
    version = max(versions(spark, path), default=0) + 1
    return version if create(spark, f"{path}/{LOG}/{version:012d}", name) else None


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` complete versions; returns the numbers removed.

    Keep as many as jobs may still be reading.
    """
    complete = [v for v in versions(spark, path) if folder(spark, path, v)]
    old = complete[: max(0, len(complete) - max(1, keep))]
    for version in old:
        data = folder(spark, path, version)
        # First the entry, so that nobody starts to read what is being removed.
        for place in (f"{path}/{LOG}/{version:012d}", data):
            target, files = _path(spark, place)
            files.delete(target, True)
    return old
