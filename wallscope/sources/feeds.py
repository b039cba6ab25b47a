"""Blocklist feeds: raw text to validated entries, snapshots and their metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wallscope.functions.addresses import with_network_key
from wallscope.functions.text import WHITESPACE_CLASS, float_text, strip, usable_time
from wallscope.operators.covering import collapse, network_text
from wallscope.schemas import FEED_META, NETWORK_KEY, THREAT_NETWORK
from wallscope.session import materialize, scratch_scope
from wallscope.sources import snapshots
from wallscope.sources.logs import path_exists

# The feeds read by default and the optional ones, by name.
DEFAULT_SOURCES = {
    "firehol_level1": "https://raw.githubusercontent.com/firehol/blocklist-ipsets/master/firehol_level1.netset",
    "emerging_threats": "https://rules.emergingthreats.net/fwrules/emerging-Block-IPs.txt",
}
EXTRA_SOURCES = {
    "firehol_level2": "https://raw.githubusercontent.com/firehol/blocklist-ipsets/master/firehol_level2.netset",
    "firehol_webserver": "https://raw.githubusercontent.com/firehol/blocklist-ipsets/master/firehol_webserver.netset",
    "firehol_anonymous": "https://raw.githubusercontent.com/firehol/blocklist-ipsets/master/firehol_anonymous.netset",
    "blocklist_de": "https://lists.blocklist.de/lists/all.txt",
    "alienvault_reputation": "https://reputation.alienvault.com/reputation.data",
}
ADDRESS_ONLY_SOURCES = ("emerging_threats",)

NETWORKS_FOLDER = "networks"
META_FOLDER = "meta"


def _source_of_file() -> Column:
    """``firehol_level1.netset`` belongs to source ``firehol_level1``; so does its gzip file."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)\.[^.]*(\.gz)?$", 1)


def read_feed_lines(spark: SparkSession, path: str, pattern: str = "*.netset") -> DataFrame:
    """Raw lines of all feed files of a folder as (source, line)."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    return lines.select(_source_of_file().alias("source"), F.col("value").alias("line"))


def select_sources(feed_lines: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Only the named sources; the list is explicit data (D7)."""
    return feed_lines.where(F.col("source").isin(list(sources)))


def normalize_address_only(feed_lines: DataFrame) -> DataFrame:
    """Lines of feeds that list bare addresses, some of them commented out.

    One leading ``"# "`` is cut; blanks, other comments and everything that is
    not a single valid address are dropped (so are networks).
    """
    text = strip(F.col("line"))
    uncommented = F.when(text.startswith("# "), strip(text.substr(F.lit(3), F.length(text)))).otherwise(text)
    lines = feed_lines.select("source", uncommented.alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    keyed = with_network_key(lines, "line")
    return keyed.where(F.col("plen").isNotNull() & ~F.col("line").contains("/")).select("source", "line")


def normalize(feed_lines: DataFrame) -> DataFrame:
    """Source-specific clean-up; other feeds pass through unchanged."""
    special = F.col("source").isin(list(ADDRESS_ONLY_SOURCES))
    return normalize_address_only(feed_lines.where(special)).unionByName(
        feed_lines.where(~special).select("source", "line")
    )


def load_entries(feed_lines: DataFrame) -> DataFrame:
    """Valid, distinct entries of each source, with their network keys.

    The first word of a line counts; blank and ``#`` lines are skipped. Entries
    are deduplicated as text before they are parsed.
    """
    text = strip(F.col("line"))
    words = feed_lines.select("source", text.alias("line")).where(
        (F.col("line") != "") & ~F.col("line").startswith("#")
    )
    entries = words.select(
        "source", F.regexp_extract("line", f"^[^{WHITESPACE_CLASS}]+", 0).alias("entry")
    ).distinct()
    keyed = with_network_key(entries, "entry").where(F.col("plen").isNotNull())
    return keyed.select(*THREAT_NETWORK.fieldNames())


def collapsed(networks: DataFrame) -> DataFrame:
    """The fewest networks per source with the same addresses (``THREAT_NETWORK``): nested and adjacent ones are merged."""
    merged = collapse(networks.select("source", *NETWORK_KEY.fieldNames()), "source")
    return merged.selectExpr("*", f"{network_text()} AS entry").select(*THREAT_NETWORK.fieldNames())


def entry_counts(networks: DataFrame) -> DataFrame:
    """Entries per source and over all sources."""
    total = networks.agg(F.count("*")).scalar()
    return networks.groupBy("source").agg(F.count("*").alias("entries")).withColumn("total_entries", total)


# --- metadata -------------------------------------------------------------------


def read_meta_files(spark: SparkSession, path: str, pattern: str = "*.meta") -> DataFrame:
    """One row (source, content) per metadata file of a folder."""
    files = spark.read.option("pathGlobFilter", pattern).option("wholetext", True).text(path)
    return files.select(_source_of_file().alias("source"), F.col("value").alias("content"))


def meta_hash(timestamp: Column, count: Column, url: Column) -> Column:
    """md5 of ``timestamp:count:url``, the timestamp printed as Python prints it."""
    return F.md5(F.concat_ws(":", float_text(timestamp), count.cast("string"), url).cast("binary"))


def parse_meta(contents: DataFrame) -> DataFrame:
    """Metadata texts, JSON or the older ``timestamp|count|url``, as ``FEED_META``.

    Unusable metadata keeps its row with NULL values.
    """
    text = strip(F.col("content"))
    parts = F.split("text", "[|]")
    rows = contents.select("source", text.alias("text")).select(
        "source",
        F.when(F.col("text").startswith("{"), F.try_parse_json("text")).alias("json"),
        F.when(F.size(parts) >= 3, parts).alias("parts"),
    )

    def from_json(key: str, dtype: str, default: object) -> Column:
        return F.coalesce(F.try_variant_get("json", f"$.{key}", dtype), F.lit(default))

    is_json = F.col("json").isNotNull()
    part = F.col("parts")
    rows = rows.select(
        "source",
        # A stamp that JSON has as text is no number.
        F.when(is_json & (F.schema_of_variant(F.try_variant_get("json", "$.timestamp", "variant")) == "STRING"), None)
        .when(is_json, from_json("timestamp", "double", 0.0))
        .otherwise(part[0].try_cast("double"))
        .alias("timestamp"),
        F.when(is_json, from_json("count", "bigint", 0)).otherwise(part[1].try_cast("bigint")).alias("count"),
        F.when(is_json, from_json("url", "string", "")).otherwise(part[2]).alias("url"),
    )
    usable = usable_time(F.col("timestamp")) & F.col("count").isNotNull()
    rows = rows.select("source", *[F.when(usable, F.col(c)).alias(c) for c in ("timestamp", "count", "url")])
    digest = F.when(usable, meta_hash(F.col("timestamp"), F.col("count"), F.col("url")))
    return rows.withColumn("hash", digest).select(*FEED_META.fieldNames())


# --- snapshots ------------------------------------------------------------------


def publish(
    feed_lines: DataFrame, path: str, now: float, urls: Mapping[str, str] | None = None
) -> DataFrame:
    """Publish a snapshot of the landed feeds below ``path``; returns its metadata.

    The new version holds the sources that have at least one valid entry and, of all
    others, what the version before had. Entries and metadata change together, and
    only once both are written (``snapshots``). Of two jobs that publish at once, the
    second merges with what the first one made.
    """
    spark = feed_lines.sparkSession
    with scratch_scope(spark):
        entries = materialize(load_entries(normalize(feed_lines)), "feed-entries")
        known = {**DEFAULT_SOURCES, **EXTRA_SOURCES, **(urls or {})}
        while True:
            before = snapshots.current(spark, path)
            name, folder = snapshots.new_folder(path)
            _write_snapshot(entries, _metadata(entries, now, known), path, before, folder)
            if snapshots.commit(spark, path, before, name) is not None:
                break
    return read_published_meta(spark, path)


def _metadata(entries: DataFrame, now: float, urls: Mapping[str, str]) -> DataFrame:
    names = F.create_map(*[F.lit(text) for pair in urls.items() for text in pair])
    counts = entries.groupBy("source").agg(F.count("*").alias("count"))
    meta = counts.select(
        "source",
        F.lit(float(now)).alias("timestamp"),
        "count",
        F.coalesce(F.try_element_at(names, F.col("source")), F.lit("Unknown")).alias("url"),
    )
    return meta.withColumn("hash", meta_hash(F.col("timestamp"), F.col("count"), F.col("url")))


def _write_snapshot(entries: DataFrame, meta: DataFrame, path: str, before: int | None, folder: str) -> None:
    spark = entries.sparkSession
    if before is not None or path_exists(spark, f"{path}/{NETWORKS_FOLDER}"):
        # A row per source.
        renewed = F.broadcast(meta.select("source"))
        entries = entries.unionByName(read_published(spark, path, before).join(renewed, "source", "left_anti"))
        meta = meta.unionByName(read_published_meta(spark, path, before).join(renewed, "source", "left_anti"))
    # Rebalancing spreads a big source over several files instead of one task.
    entries.hint("rebalance", "source").write.partitionBy("source").parquet(f"{folder}/{NETWORKS_FOLDER}")
    store_meta(meta, f"{folder}/{META_FOLDER}")


def store_meta(meta: DataFrame, path: str) -> None:
    """Usable metadata as JSON, a file per source; what was read in the older form is converted so."""
    usable = meta.where(F.col("timestamp").isNotNull()).select(*FEED_META.fieldNames())
    usable.repartition("source").write.mode("overwrite").partitionBy("source").json(path)


def _snapshot_folder(spark: SparkSession, path: str, version: int | None) -> str:
    """Where a version lies (the current one if None); ``path`` itself as older releases wrote it, version 0."""
    number = snapshots.current(spark, path) if version is None else version
    folder = snapshots.folder(spark, path, number) if number else path
    if folder is None or not path_exists(spark, f"{folder}/{NETWORKS_FOLDER}"):
        raise FileNotFoundError(f"no published feeds in {path}" + (f", version {version}" if version else ""))
    return folder


def published_version(spark: SparkSession, path: str) -> int:
    """The number of the current snapshot, to read the same one again later."""
    number = snapshots.current(spark, path) or 0
    _snapshot_folder(spark, path, number)
    return number


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A snapshot of all published sources (``THREAT_NETWORK``): the current one or a given version."""
    table = f"{_snapshot_folder(spark, path, version)}/{NETWORKS_FOLDER}"
    return spark.read.schema(THREAT_NETWORK).parquet(table).select(*THREAT_NETWORK.fieldNames())


def read_published_meta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Metadata of a snapshot (``FEED_META``)."""
    table = f"{_snapshot_folder(spark, path, version)}/{META_FOLDER}"
    return spark.read.schema(FEED_META).json(table).select(*FEED_META.fieldNames())


def published_sources(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """Names of the published sources, one partition folder each."""
    meta = read_published_meta(spark, path, version)
    return [row.source for row in meta.select("source").distinct().sort("source").collect()]
