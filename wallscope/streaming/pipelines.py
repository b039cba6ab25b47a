"""Continuous parsing and enrichment of a growing log folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wallscope.operators.enrich import enrich
from wallscope.operators.parse import parse_all, parse_lines
from wallscope.schemas import PARSED
from wallscope.session import discard, move, scratch_scope
from wallscope.sources import snapshots
from wallscope.sources.feeds import published_sources, published_version, read_published
from wallscope.sources.logs import DEFAULT_PATTERN

BATCH_COLUMN = "batch_id"
# Readers of the output skip folders with an underscore.
VERSIONS_FOLDER = "_feed_versions"
_KIND = "kind"


def stream_parsed(
    spark: SparkSession,
    path: str,
    pattern: str = DEFAULT_PATTERN,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New log files of a folder as a stream of parsed rows."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_lines(reader.text(path))


def start_parse(
    parsed: DataFrame,
    output: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Append parsed rows to a Parquet folder, each input file exactly once."""
    writer = parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(output)


def start_parse_all(
    spark: SparkSession,
    path: str,
    output: str,
    rejects: str,
    checkpoint: str,
    pattern: str = DEFAULT_PATTERN,
    available_now: bool = False,
    interval: str = "1 minute",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Parsed rows to one folder and the lines that are none to another, from one run of the pattern.

    A micro-batch is written once, split by kind, and its two parts are then moved to their
    folders ``batch_id=<n>`` on the same file system; a batch that is repeated replaces its own.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = parse_all(batch).withColumn(_KIND, F.expr("IF(rejected IS NULL, 'parsed', 'rejected')"))
        # Beside the output, as only one file system can move folders.
        staged = f"{output}/_staged-{batch_id}"
        rows.write.mode("overwrite").partitionBy(_KIND).parquet(staged)
        for kind, target in (("parsed", output), ("rejected", rejects)):
            move(session, f"{staged}/{_KIND}={kind}", f"{target}/{BATCH_COLUMN}={batch_id}")
        discard(session, staged)

    reader = spark.readStream.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.text(path).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def read_parsed(spark: SparkSession, output: str) -> DataFrame:
    """What ``start_parse_all`` has parsed."""
    return spark.read.schema(PARSED).parquet(output).select(*PARSED.fieldNames())


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """The lines that ``start_parse_all`` has rejected."""
    return spark.read.schema("rejected string").parquet(rejects).select(F.col("rejected").alias("line"))


def pinned_version(spark: SparkSession, feeds_path: str, output: str, batch_id: int) -> int:
    """The version of the feeds for a batch: the recorded one, else the current one, which gets recorded."""
    record = f"{output}/{VERSIONS_FOLDER}/{BATCH_COLUMN}={batch_id}"
    snapshots.create(spark, record, str(published_version(spark, feeds_path)))
    return int(snapshots.read(spark, record))


def start_enrich(
    spark: SparkSession,
    parsed_path: str,
    output: str,
    checkpoint: str,
    ip_column: str = "src_ip",
    geo: Callable[[], DataFrame] | None = None,
    asn: Callable[[], DataFrame] | None = None,
    feeds_path: str | None = None,
    available_now: bool = False,
    interval: str = "1 minute",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Enrich a parsed folder as it grows, with the batch operators.

    Network tables and feed snapshots are looked up anew for every micro-batch,
    so a refreshed feed takes effect without a restart. The version of the feeds
    that a batch uses is recorded before its work begins: a batch that is repeated
    after a failure uses the same one, whatever was published since, and replaces
    its own folder ``batch_id=<n>``. Its files are read
    twice, for addresses and for rows, and not copied; ``max_files_per_trigger``
    bounds a batch, the first one too.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        version = pinned_version(session, feeds_path, output, batch_id) if feeds_path else None
        threats = read_published(session, feeds_path, version) if feeds_path else None
        sources = published_sources(session, feeds_path, version) if feeds_path else None
        with scratch_scope(session):
            enriched = enrich(
                batch,
                ip_column,
                geo=geo() if geo else None,
                asn=asn() if asn else None,
                threats=threats,
                sources=sources,
            )
            enriched.write.mode("overwrite").parquet(f"{output}/{BATCH_COLUMN}={batch_id}")

    reader = spark.readStream.schema(PARSED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(parsed_path)
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
