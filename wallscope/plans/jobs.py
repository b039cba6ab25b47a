"""The jobs a user runs: networks, publish, parse, enrich, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wallscope.operators import enrich as enrichment
from wallscope.operators.feedinfo import feed_info, staleness
from wallscope.operators.parse import parse_lines
from wallscope.plans import reports
from wallscope.schemas import FEED_META
from wallscope.session import scratch_scope
from wallscope.sources import feeds
from wallscope.sources.logs import DEFAULT_PATTERN, read_lines, read_table, write_table
from wallscope.sources.networks import asn_networks, geo_networks


def parse_logs(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    pattern: str = DEFAULT_PATTERN,
    partitions: int | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """Parse a file or folder; with ``output_path`` the result is the stored table.

    ``counts`` observes the numbers of lines, parsed and rejected ones as they are written.
    """
    parsed = parse_lines(read_lines(spark, input_path, pattern, partitions), counts=counts)
    return _stored(parsed, output_path)


def enrich_logs(
    spark: SparkSession,
    logs: DataFrame | str,
    ip_column: str = "src_ip",
    geo_path: str | None = None,
    asn_path: str | None = None,
    feeds_path: str | None = None,
    output_path: str | None = None,
) -> DataFrame:
    """Enrich a stored log table with whatever tables are named.

    ``logs`` is a table path or a DataFrame; ``geo_path`` and ``asn_path`` are
    network tables, ``feeds_path`` a folder of published feeds. Missing inputs
    raise ``FileNotFoundError`` before any work is done.
    """
    geo = read_table(spark, geo_path) if geo_path else None
    asn = read_table(spark, asn_path) if asn_path else None
    version = feeds.published_version(spark, feeds_path) if feeds_path else None
    threats = feeds.read_published(spark, feeds_path, version) if feeds_path else None
    sources = feeds.published_sources(spark, feeds_path, version) if feeds_path else None
    events = read_table(spark, logs) if isinstance(logs, str) else logs
    if output_path is None:
        return enrichment.enrich(events, ip_column, geo, asn, threats, sources)
    with scratch_scope(spark):
        return _stored(enrichment.enrich(events, ip_column, geo, asn, threats, sources), output_path)


def build_networks(spark: SparkSession, records_path: str, output_path: str, kind: str) -> DataFrame:
    """Make a network table, once per release, from stored city or owner records.

    ``kind`` is ``geo`` or ``asn``; records hold a CIDR column ``network``.
    """
    records = read_table(spark, records_path)
    enrichment.require_columns(records, "network")
    return _stored(geo_networks(records) if kind == "geo" else asn_networks(records), output_path)


def enrich_logs_with_geo(
    spark: SparkSession,
    logs: DataFrame | str,
    geo_path: str,
    ip_column: str = "src_ip",
    output_path: str | None = None,
    asn_path: str | None = None,
) -> DataFrame:
    return enrich_logs(spark, logs, ip_column, geo_path, asn_path, output_path=output_path)


def enrich_logs_with_threats(
    spark: SparkSession,
    logs: DataFrame | str,
    feeds_path: str,
    ip_column: str = "src_ip",
    output_path: str | None = None,
) -> DataFrame:
    return enrich_logs(spark, logs, ip_column, feeds_path=feeds_path, output_path=output_path)


def _stored(df: DataFrame, output_path: str | None) -> DataFrame:
    if output_path is None:
        return df
    write_table(df, output_path)
    return read_table(df.sparkSession, output_path)


def traffic_reports(
    df: DataFrame,
    number: int = reports.TOP_LOCATIONS,
    ports: int = reports.TOP_PORTS,
    protocol: bool = False,
    hourly: bool = False,
    source_ports: bool = False,
    interfaces: bool = False,
    asn: bool = False,
    threat_intel: bool = False,
    on_skip: Callable[[str, str], None] = lambda report, columns: None,
) -> dict[str, DataFrame]:
    """The selected reports by name; cities and countries are always included.

    The log is read once, for one stored table of the sets of columns that the selected
    reports group by (``reports.grouped``). A selected report whose columns are missing is
    left out; ``on_skip`` gets its name and the columns.
    """
    enrichment.require_columns(df, "geo_city", "geo_country_name", "dst_port", "src_ip")
    sets: dict[str, list[str]] = {
        "city": ["geo_city", "dst_port", "src_ip"],
        "country": ["geo_country_name", "dst_port", "src_ip"],
    }
    build: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
        "top_cities": ("city", lambda rows: reports.top_cities(rows, number)),
        "city_ports": ("city", lambda rows: reports.city_ports(rows, number, ports)),
        "top_countries": ("country", lambda rows: reports.top_countries(rows, number)),
        "country_ports": ("country", lambda rows: reports.country_ports(rows, number, ports)),
    }

    def add(name: str, columns: Sequence[str] | None, needed: str, report: Callable[[DataFrame], DataFrame]) -> None:
        """A report of rows grouped by ``columns``; None if some of those ``needed`` are missing."""
        if columns is None:
            on_skip(name, needed)
            return
        key = ",".join(columns)
        sets[key] = list(columns)
        build[name] = (key, report)

    def given(*columns: str) -> list[str] | None:
        return list(columns) if all(column in df.columns for column in columns) else None

    if protocol:
        add("protocol_distribution", given("protocol"), "protocol", reports.protocol_distribution)
    if hourly:
        timed = given("timestamp_local") or given("timestamp")
        if timed:
            df = df.withColumn("hour", reports.hour_of(df))
        add("hourly_traffic", ["hour"] if timed else None, "timestamp_local or timestamp", reports.hour_distribution)
    if source_ports:
        add("source_ports", given("src_port"), "src_port", reports.source_ports)
    if interfaces:
        add("interface_distribution", given("interface"), "interface", reports.interface_distribution)
        both = given("interface", "direction")
        add("interface_directions", both, "interface, direction", reports.interface_directions)
    owner = reports.asn_columns(df)
    if asn:
        owned = [*owner, "dst_port", "src_ip"] if owner else None
        add("top_asns", owned, "asn, asn_org", lambda rows: reports.top_asns(rows, number))
        add("asn_ports", owned, "asn, asn_org", lambda rows: reports.asn_ports(rows, number, ports))
    if threat_intel:
        flag = enrichment.MALICIOUS
        flags = reports.threat_source_columns(df)
        add("threat_summary", given(flag), flag, reports.threat_summary)
        add("threat_by_source", given(flag, *flags) if flags else None, "threat_<source>", reports.threat_by_source)
        add("threat_by_country", given("geo_country_name", flag), flag, reports.threat_by_country)
        add("threat_by_asn", given(*owner, flag) if owner else None, f"{flag}, asn, asn_org", reports.threat_by_asn)
    tables = reports.grouped(df, sets)
    return {name: report(tables[key]) for name, (key, report) in build.items()}


def publish_feeds(
    spark: SparkSession,
    landing_path: str,
    feeds_path: str,
    now: float,
    sources: Sequence[str] | None = None,
    pattern: str = "*",
    only_stale: bool = False,
) -> DataFrame:
    """Publish raw feed files that have landed; the name before the suffix is the source.

    ``sources`` limits and names what is published; default: the default feeds. With
    ``only_stale`` those whose published snapshot is still fresh at ``now`` are left alone.
    """
    lines = feeds.read_feed_lines(spark, landing_path, pattern)
    wanted = list(sources) if sources else list(feeds.DEFAULT_SOURCES)
    if only_stale:
        wanted = stale_sources(spark, feeds_path, now, wanted)
        if not wanted:
            return feeds.read_published_meta(spark, feeds_path)
    return feeds.publish(feeds.select_sources(lines, wanted), feeds_path, now)


def stale_sources(spark: SparkSession, feeds_path: str, now: float, sources: Sequence[str]) -> list[str]:
    """Those of ``sources`` that were never published or need a refresh at ``now``."""
    try:
        meta = feeds.read_published_meta(spark, feeds_path)
    except FileNotFoundError:
        return list(sources)
    # A row per source.
    fresh = {row.source for row in staleness(meta, now).where("NOT needs_refresh").collect()}
    return [source for source in sources if source not in fresh]


def convert_metadata(spark: SparkSession, meta_path: str, output_path: str) -> DataFrame:
    """Metadata files of any age, stored again as JSON; returns what is stored (``FEED_META``)."""
    feeds.store_meta(feeds.parse_meta(feeds.read_meta_files(spark, meta_path)), output_path)
    return spark.read.schema(FEED_META).json(output_path).select(*FEED_META.fieldNames())


def publish_outcome(spark: SparkSession, feeds_path: str, now: float, sources: Sequence[str]) -> DataFrame:
    """What publishing at ``now`` did for each source: published, kept (its old snapshot) or missing."""
    asked = spark.createDataFrame([(source,) for source in sources], "source string").distinct()
    found = feeds.read_published_meta(spark, feeds_path).select("source", "timestamp")
    outcome = (
        F.when(F.col("timestamp") == F.lit(float(now)), "published")
        .when(F.col("found"), "kept")
        .otherwise("missing")
    )
    joined = asked.join(found.withColumn("found", F.lit(True)), "source", "left")
    return joined.select("source", outcome.alias("outcome")).orderBy("source")


def describe_feeds(spark: SparkSession, feeds_path: str, now: float) -> DataFrame:
    """Count, update time, URL, age and staleness of the published feeds."""
    meta = feeds.read_published_meta(spark, feeds_path)
    info = feed_info(meta, now, {**feeds.DEFAULT_SOURCES, **feeds.EXTRA_SOURCES})
    stale = staleness(meta, now).select("source", "needs_refresh")
    return info.join(stale, "source").orderBy("source")
