"""Every query of the catalogue: name -> function of (spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wallscope.functions.addresses import with_address_key, with_network_key
from wallscope.functions.services import service_name
from wallscope.operators import covering, enrich, feedinfo
from wallscope.operators.parse import parse_lines, rejected_lines
from wallscope.operators.prefix_join import longest_match
from wallscope.plans import jobs, reports
from wallscope.schemas import FEED_META
from wallscope.session import scratch_path
from wallscope.sources import feeds, logs
from wallscope.streaming import pipelines
from workload import views

Query = Callable[[SparkSession, str], DataFrame]

SOURCES = sorted(feeds.DEFAULT_SOURCES)
# Rows of a sample are picked by time; the event number breaks ties.
BY_TIME = ("timestamp", "event_id")

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _printable(parsed: DataFrame, *keep: str) -> DataFrame:
    """Parsed columns with times as text and epoch seconds, to compare engines."""
    plain = [name for name in parsed.columns if name not in ("timestamp", "timestamp_local", *keep)]
    return parsed.select(
        *keep,
        F.unix_seconds("timestamp").alias("epoch_seconds"),
        F.date_format("timestamp_local", "yyyy-MM-dd HH:mm:ss").alias("local_time"),
        *plain,
    )


# --- parsing ------------------------------------------------------------------------


@query
def src_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and gzipped files of one folder, picked by a file pattern."""
    path = scratch_path(spark, "raw-logs")
    raw = views.lines(spark, sf_dir)
    for remainder, codec in ((0, "none"), (1, "gzip")):
        part = raw.where(F.col("event_id") % 2 == remainder).select("value")
        part.write.mode("append").option("compression", codec).text(path)
    return _printable(jobs.parse_logs(spark, path, pattern="*.txt*"))


@query
def parse_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printable(views.parsed(spark, sf_dir), "event_id")


QUERIES["parse_lines"] = QUERIES.pop("parse_lines_query")


@query
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(views.lines(spark, sf_dir), keep=["event_id"])


@query
def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, parsed and rejected ones, observed while the parsed table is written."""
    counts = Observation("counts")
    logs.write_table(parse_lines(views.lines(spark, sf_dir), counts=counts), scratch_path(spark, "observed"))
    numbers = counts.get
    return spark.sql(f"SELECT {', '.join(f'{numbers[name]}L AS {name}' for name in ('lines', 'parsed', 'rejected'))}")


@query
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by kind from a stream that runs the pattern once."""
    raw, output = scratch_path(spark, "raw-stream"), scratch_path(spark, "parsed-stream")
    views.lines(spark, sf_dir).select("value").write.text(raw)
    rejects, state = scratch_path(spark, "rejects-stream"), scratch_path(spark, "state")
    pipelines.start_parse_all(spark, raw, output, rejects, state, "*.txt", available_now=True).awaitTermination()
    parsed = pipelines.read_parsed(spark, output).select(F.lit("parsed").alias("kind"), F.col("timestamp_raw").alias("text"))
    return parsed.unionByName(pipelines.read_rejects(spark, rejects).select(F.lit("rejected").alias("kind"), F.col("line").alias("text")))


@query
def parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = views.parsed(spark, sf_dir)
    return times.select(
        "event_id",
        "timestamp_raw",
        F.unix_seconds("timestamp").alias("epoch_seconds"),
        F.hour("timestamp_local").cast("bigint").alias("local_hour"),
    )


@query
def parse_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parsed(spark, sf_dir).select("event_id", "protocol", "tcp_flags", "length", "seq", "win")


@query
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sink")
    logs.write_table(views.parsed(spark, sf_dir), path)
    return _printable(logs.read_table(spark, path), "event_id")


@query
def row_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.row_total(views.parsed(spark, sf_dir))


# --- addresses and networks -----------------------------------------------------------


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.ADDRESSES)


def _exact(*columns: str) -> list[Column]:
    """Full 64-bit numbers as text: a data frame with NULLs would show them as floats."""
    return [F.col(c).cast("string").alias(c) for c in columns]


@query
def ip_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_address_key(_addresses(spark, sf_dir), "ip")
    return keyed.select("event_id", "ip", F.col("family").isNotNull().alias("is_valid"))


@query
def ip_to_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_address_key(_addresses(spark, sf_dir), "ip")
    return keyed.select("event_id", "ip", F.col("family").cast("bigint").alias("family"), *_exact("hi", "lo"))


@query
def cidr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_network_key(views.view(spark, sf_dir, views.CIDRS), "cidr")
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("family", "plen")]
    return keyed.select("event_id", "cidr", *numbers, *_exact("hi", "lo"))


@query
def ip_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = enrich.distinct_addresses(_addresses(spark, sf_dir), "ip")
    return enrich.build_address_table(addresses)


QUERIES["service_name"] = lambda spark, sf_dir: (
    views.parsed(spark, sf_dir)
    .select(F.explode(F.array("src_port", "dst_port")).alias("port"))
    .distinct()
    .select("port", service_name("port").alias("service"))
)


@query
def distinct_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.distinct_addresses(views.parsed(spark, sf_dir))


# --- feeds ------------------------------------------------------------------------------


def _entries(networks: DataFrame) -> DataFrame:
    return networks.select("source", "entry", F.col("plen").cast("bigint").alias("plen"), "hi")


@query
def feed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.feed_lines(spark, sf_dir)
    return _entries(feeds.load_entries(feeds.select_sources(raw, ["firehol_level1"])))


@query
def feed_ip_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.feed_lines(spark, sf_dir)
    return feeds.normalize_address_only(feeds.select_sources(raw, ["emerging_threats"]))


@query
def feed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(feeds.load_entries(feeds.normalize(views.feed_lines(spark, sf_dir))))


@query
def feed_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parse_meta(views.feed_meta(spark, sf_dir))


@query
def feed_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedinfo.staleness(feeds.parse_meta(views.feed_meta(spark, sf_dir)), views.NOW)


@query
def feed_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedinfo.feed_info(feeds.parse_meta(views.feed_meta(spark, sf_dir)), views.NOW)


@query
def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.entry_counts(views.threat_table(spark, sf_dir))


@query
def feed_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish all feeds, then once more with no valid line for one of them."""
    path = scratch_path(spark, "feeds")
    raw = views.feed_lines(spark, sf_dir)
    feeds.publish(raw, path, views.NOW)
    spoiled = F.when(F.col("source") == "firehol_level1", F.lit("# empty")).otherwise(F.col("line"))
    meta = feeds.publish(raw.withColumn("line", spoiled), path, views.NOW + 60)
    entries = feeds.read_published(spark, path).select("source", "entry")
    return entries.join(meta.select("source", "timestamp", "count", "hash"), "source")


@query
def feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by a version that was current before the feeds were published anew."""
    path = scratch_path(spark, "feeds")
    raw = views.feed_lines(spark, sf_dir)
    feeds.publish(raw, path, views.NOW)
    version = feeds.published_version(spark, path)
    feeds.publish(raw.withColumn("line", F.lit("192.0.2.1")), path, views.NOW + 60)
    return enrich.network_matches(_distinct(spark, sf_dir), feeds.read_published(spark, path, version))


@query
def feed_meta_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of both forms, stored again as JSON."""
    path = scratch_path(spark, "meta")
    feeds.store_meta(feeds.parse_meta(views.feed_meta(spark, sf_dir)), path)
    return spark.read.schema(FEED_META).json(path).select(*FEED_META.fieldNames())


# --- geography ----------------------------------------------------------------------------


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.distinct_addresses(views.parsed(spark, sf_dir))


@query
def geo_lpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = longest_match(_distinct(spark, sf_dir), views.geo_table(spark, sf_dir))
    return found.select("ip", F.col("plen").cast("bigint").alias("plen"), "network", "country_name", "city")


@query
def asn_lpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = longest_match(_distinct(spark, sf_dir), views.asn_table(spark, sf_dir))
    return found.select("ip", F.col("plen").cast("bigint").alias("plen"), "network", "asn", "asn_org")


GEO_SHOWN = list(enrich.GEO_COLUMNS)
THREAT_SHOWN = [enrich.MALICIOUS, *[enrich.threat_column(source) for source in SOURCES]]


def _with_geo(spark: SparkSession, sf_dir: str, ip_column: str = "src_ip") -> DataFrame:
    return enrich.enrich_with_geolocation(
        views.parsed_table(spark, sf_dir),
        views.geo_table(spark, sf_dir),
        ip_column,
        views.asn_table(spark, sf_dir),
    )


@query
def enrich_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_geo(spark, sf_dir).select("event_id", "src_ip", *GEO_SHOWN)


@query
def enrich_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_geo(spark, sf_dir, "dst_ip").select("event_id", "dst_ip", *GEO_SHOWN)


@query
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = views.parsed_table(spark, sf_dir).select(F.col("event_id").alias("pos"), F.col("src_ip").alias("ip"))
    found = enrich.batch_lookup(batch, views.geo_table(spark, sf_dir), views.asn_table(spark, sf_dir))
    return found.select("pos", "ip", *[name.removeprefix("geo_") for name in GEO_SHOWN])


@query
def geo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.location_counts(views.parsed(spark, sf_dir), views.geo_table(spark, sf_dir))


@query
def enrich_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known about IPv6 addresses: special ranges, city, owner and verdicts."""
    addresses = views.view(spark, sf_dir, views.ADDRESSES6)
    found = enrich.build_address_table(addresses, *views.v6_tables(spark, sf_dir), SOURCES)
    return found.select("ip", "is_private", *GEO_SHOWN, *THREAT_SHOWN)


@query
def threat_cidr_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.network_matches(views.view(spark, sf_dir, views.ADDRESSES6), views.v6_tables(spark, sf_dir)[2])


@query
def range_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The networks that cover address ranges."""
    return covering.range_networks(views.view(spark, sf_dir, views.RANGES)).select("event_id", "network")


# --- threats --------------------------------------------------------------------------------


def _with_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_with_threats(
        views.parsed_table(spark, sf_dir), views.threat_table(spark, sf_dir), sources=SOURCES
    )


def _with_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(
        views.parsed_table(spark, sf_dir),
        "src_ip",
        views.geo_table(spark, sf_dir),
        views.asn_table(spark, sf_dir),
        views.threat_table(spark, sf_dir),
        SOURCES,
    )


@query
def threat_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.exact_matches(_distinct(spark, sf_dir), views.threat_table(spark, sf_dir))


@query
def threat_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.network_matches(_distinct(spark, sf_dir), views.threat_table(spark, sf_dir))


@query
def feed_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds with nested and adjacent networks merged."""
    return feeds.collapsed(views.threat_table(spark, sf_dir)).select("source", "entry")


@query
def threat_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.network_matches(_distinct(spark, sf_dir), feeds.collapsed(views.threat_table(spark, sf_dir)))


@query
def threat_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.is_malicious(_distinct(spark, sf_dir), views.threat_table(spark, sf_dir))


@query
def threat_verdict_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich.verdicts(_distinct(spark, sf_dir), views.threat_table(spark, sf_dir), SOURCES)
    return found.select("ip", F.explode("verdicts").alias("source", "flag"))


@query
def enrich_threat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_threats(spark, sf_dir).select("event_id", "src_ip", *THREAT_SHOWN)


@query
def threat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threat_summary(_with_threats(spark, sf_dir))


@query
def threat_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threat_by_source(_with_threats(spark, sf_dir))


@query
def threat_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threat_by_country(_with_all(spark, sf_dir))


@query
def threat_by_asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threat_by_asn(_with_all(spark, sf_dir))


@query
def threat_ip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = enrich.address_counts(views.parsed(spark, sf_dir))
    table = enrich.build_address_table(counts, threats=views.threat_table(spark, sf_dir), sources=SOURCES)
    return reports.threat_address_summary(table)


# --- combined enrichment -----------------------------------------------------------------------


@query
def enrich_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_all(spark, sf_dir).select("event_id", "src_ip", "dst_port", *GEO_SHOWN, *THREAT_SHOWN)


@query
def enrich_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every address of more than a few rows dealt to several parts."""
    tables = [build(spark, sf_dir) for build in (views.geo_table, views.asn_table, views.threat_table)]
    found = enrich.enrich(views.parsed_table(spark, sf_dir), "src_ip", *tables, SOURCES, hot_rows=3)
    return found.select("event_id", "src_ip", "dst_port", *GEO_SHOWN, *THREAT_SHOWN)


@query
def enrich_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.enrichment_summary(_with_all(spark, sf_dir))


@query
def enrich_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.leading_countries(_with_geo(spark, sf_dir))


@query
def sample_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = reports.sample_parsed(views.parsed(spark, sf_dir), order=BY_TIME)
    return _printable(sample, "event_id")


@query
def sample_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample_enriched(_with_all(spark, sf_dir), limit=20, order=BY_TIME, keep=["event_id"])


@query
def sample_malicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample_malicious(_with_all(spark, sf_dir), limit=20, order=BY_TIME, keep=["event_id"])


# --- traffic reports -----------------------------------------------------------------------------


@query
def protocol_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.protocol_distribution(views.parsed(spark, sf_dir))


@query
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    traffic = reports.hourly_traffic(views.parsed(spark, sf_dir))
    return traffic.withColumn("hour", F.col("hour").cast("bigint"))


@query
def top_src_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_ports(views.parsed(spark, sf_dir))


@query
def top_src_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_source_addresses(views.parsed(spark, sf_dir))


@query
def interface_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.interface_distribution(views.parsed(spark, sf_dir))


@query
def interface_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.interface_directions(views.parsed(spark, sf_dir))


@query
def top_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_cities(_with_geo(spark, sf_dir))


@query
def countries_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries from sketches kept per day: are the distinct sources within six standard deviations?"""
    events = _with_geo(spark, sf_dir)
    path = scratch_path(spark, "days")
    logs.write_table(reports.daily_sources(events, "geo_country_name"), path)
    estimates = reports.merged_locations(logs.read_table(spark, path), "geo_country_name")
    exact = reports.top_countries(events).select("geo_country_name", F.col("unique_sources").alias("exact"))
    near = F.abs(F.col("unique_sources") - F.col("exact")) <= 6 * 1.04 / 64 * F.col("exact") + 1
    return estimates.join(exact, "geo_country_name").select("geo_country_name", "connections", near.alias("near"))


@query
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_countries(_with_geo(spark, sf_dir))


@query
def top_asns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_asns(_with_geo(spark, sf_dir))


@query
def city_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.city_ports(_with_geo(spark, sf_dir))


@query
def country_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.country_ports(_with_geo(spark, sf_dir))


@query
def asn_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.asn_ports(_with_geo(spark, sf_dir))


# --- streaming --------------------------------------------------------------------------------------


@query
def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files to parsed rows by a stream that ends when all files are read."""
    raw, out, state = (scratch_path(spark, f"stream-{part}") for part in ("raw", "parsed", "state"))
    views.lines(spark, sf_dir).select("value").write.text(raw)
    parsed = pipelines.stream_parsed(spark, raw, pattern="*.txt*")
    pipelines.start_parse(parsed, out, state, available_now=True).awaitTermination()
    return _printable(logs.read_table(spark, out))


@query
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed folder to enriched rows, with the feeds published beforehand."""
    source, out, state, published = (
        scratch_path(spark, f"stream-{part}") for part in ("source", "enriched", "state", "feeds")
    )
    views.parsed(spark, sf_dir).drop("event_id").write.parquet(source)
    feeds.publish(views.feed_lines(spark, sf_dir), published, views.NOW)
    stream = pipelines.start_enrich(
        spark,
        source,
        out,
        state,
        geo=lambda: views.geo_table(spark, sf_dir),
        asn=lambda: views.asn_table(spark, sf_dir),
        feeds_path=published,
        available_now=True,
    )
    stream.awaitTermination()
    columns = ["timestamp_raw", "src_ip", "src_port", *GEO_SHOWN, *THREAT_SHOWN]
    return logs.read_table(spark, out).select(*columns)
