"""Traffic and threat reports as DataFrames.

Every report aggregates before it ranks and ranks with a total order: count
descending, then key ascending. Totals are scalar subqueries, so no report needs
a join or a single-partition window for its percentages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallscope.functions.services import UNKNOWN, service_name
from wallscope.functions.text import percent
from wallscope.operators.enrich import MALICIOUS, require_columns
from wallscope.session import materialize

#: Column of tables made by ``grouped``: how many log rows a row stands for.
ROWS = "__rows"
_SET = "__set"

TOP_LOCATIONS = 10
TOP_PORTS = 5
TOP_SOURCE_PORTS = 10
TOP_THREATS = 10


def grouped(df: DataFrame, sets: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """For each named set of columns its combinations with the number of their rows.

    The log is read once, by one expansion and one aggregation over all sets; each set's
    rows are combined within the tasks before they are shuffled. The result is stored, a
    folder per set. Reports take such a table in place of the log, with the same results.
    """
    columns = sorted({name for names in sets.values() for name in names})
    # The bit of a column that is not in the set is 1, the first column's bit the highest.
    numbers = {
        name: sum(1 << (len(columns) - 1 - i) for i, column in enumerate(columns) if column not in names)
        for name, names in sets.items()
    }
    wanted = {numbers[name]: [F.col(f"`{c}`") for c in names] for name, names in sets.items()}
    keys = [F.col(f"`{c}`") for c in columns]
    counts = df.select(*keys).groupingSets(list(wanted.values()), *keys)
    counts = counts.agg(F.count("*").alias(ROWS), F.grouping_id().alias(_SET))
    table = materialize(counts, "report-sets", by=_SET)
    return {name: table.where(F.col(_SET) == numbers[name]).select(*names, ROWS) for name, names in sets.items()}


def _rows(df: DataFrame, condition: Column | None = None) -> Column:
    """The number of log rows that the rows of ``df`` stand for, of all or those of a condition."""
    if ROWS not in df.columns:
        return F.count("*") if condition is None else F.count_if(condition)
    rows = F.col(ROWS) if condition is None else F.when(condition, F.col(ROWS))
    return F.coalesce(F.sum(rows), F.lit(0).cast("bigint"))


def _with_shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and share of all rows per combination of ``keys`` without a NULL.

    Rows are read and aggregated once: the total is summed up from the same
    counts. Groups with NULL are dropped by a generator, because Catalyst would
    move a filter on the keys under the aggregation of one side only, and the two
    sides could not share it any more.
    """
    counts = df.groupBy(*keys).agg(_rows(df).alias("connections"))
    total = counts.agg(F.sum("connections")).scalar()
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    rows = counts.select(F.inline(F.when(known, F.array(F.struct(*keys, "connections")))))
    return rows.withColumn("pct", percent(F.col("connections"), total))


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(_rows(df).alias("rows"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of all rows per value; NULL is no value but is in the total."""
    require_columns(df, column)
    return _with_shares(df, [column])


def protocol_distribution(df: DataFrame) -> DataFrame:
    return value_distribution(df, "protocol").orderBy(F.desc("connections"), "protocol")


def interface_distribution(df: DataFrame) -> DataFrame:
    return value_distribution(df, "interface").orderBy(F.desc("connections"), "interface")


def hourly_traffic(df: DataFrame) -> DataFrame:
    """Connections per hour of the log's own wall clock; empty hours are left out.

    A table without ``timestamp_local`` may have ``timestamp``, as a time (of the session's
    zone) or as text, whose zone is not applied; text that is no time counts as NULL.
    """
    return hour_distribution(df.select(hour_of(df).alias("hour")))


def hour_of(df: DataFrame) -> Column:
    """The hour of the log's own wall clock."""
    name = "timestamp_local" if "timestamp_local" in df.columns else "timestamp"
    require_columns(df, name)
    return F.hour(F.col(name).try_cast("timestamp_ntz")).cast("int")


def hour_distribution(df: DataFrame) -> DataFrame:
    return value_distribution(df, "hour").orderBy("hour")


def source_ports(df: DataFrame, limit: int = TOP_SOURCE_PORTS) -> DataFrame:
    ranked = value_distribution(df, "src_port").orderBy(F.desc("connections"), "src_port").limit(limit)
    return ranked.withColumn("service", service_name("src_port"))


def top_source_addresses(df: DataFrame, limit: int = 10) -> DataFrame:
    counts = df.where(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(_rows(df).alias("connections"))
    return counts.orderBy(F.desc("connections"), "src_ip").limit(limit)


def interface_directions(df: DataFrame) -> DataFrame:
    """Connections per interface and direction, with their share of all rows."""
    require_columns(df, "interface", "direction")
    shares = _with_shares(df, ["interface", "direction"])
    return shares.orderBy("interface", F.desc("connections"), "direction")


# --- locations and their ports ------------------------------------------------------


def _top_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The most frequent values of ``key`` as (``key``, ``connections``)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(_rows(df).alias("connections"))
    return counts.orderBy(F.desc("connections"), key).limit(limit)


def _rows_of_top_keys(df: DataFrame, key: str, limit: int, columns: Sequence[str]) -> DataFrame:
    """Rows of the most frequent keys only, each with its key's ``connections``.

    Catalyst sees the limit, so it knows whether the list is small enough to be broadcast.
    """
    top = _top_keys(df, key, limit).withColumnRenamed(key, "__key")
    rows = df.select(key, *[c for c in columns if c != key])
    return rows.join(top, F.col(key) == F.col("__key")).select(*rows.columns, "connections")


def top_locations(
    df: DataFrame, key: str, limit: int = TOP_LOCATIONS, label: str | None = None
) -> DataFrame:
    """The ``limit`` most frequent values of ``key`` with their distinct sources.

    Rows are cut down to those keys before sources are made distinct. ``label``
    names a column of which the least value is reported per key.
    """
    require_columns(df, key, "src_ip")
    columns = ["src_ip", *([label] if label else [])]
    rows = _rows_of_top_keys(df, key, limit, columns)
    result = rows.groupBy(key, "connections").agg(
        F.count_distinct("src_ip").alias("unique_sources"),
        *([F.min(label).alias(label)] if label else []),
    )
    if label:
        result = result.withColumn(label, F.coalesce(label, F.lit(UNKNOWN)))
    return result.orderBy(F.desc("connections"), key)


def location_ports(
    df: DataFrame, key: str, limit: int = TOP_LOCATIONS, ports: int = TOP_PORTS
) -> DataFrame:
    """The most used destination ports of each of the most frequent locations."""
    require_columns(df, key, "dst_port", "src_ip")
    weight = [ROWS] if ROWS in df.columns else []
    rows = _rows_of_top_keys(df, key, limit, ["dst_port", "src_ip", *weight])
    # A busy location or port is spread over its sources before it is summed up.
    per_source = (
        rows.where(F.col("dst_port").isNotNull())
        .groupBy(key, "connections", "dst_port", "src_ip")
        .agg(_rows(rows).alias("n"))
    )
    per_port = per_source.groupBy(key, "connections", "dst_port").agg(
        F.sum("n").alias("port_connections"), F.count("src_ip").alias("port_unique_sources")
    )
    order = Window.partitionBy(key).orderBy(F.desc("port_connections"), "dst_port")
    ranked = per_port.withColumn("port_rank", F.row_number().over(order).cast("bigint"))
    report = ranked.where(F.col("port_rank") <= ports).select(
        key,
        "connections",
        "port_rank",
        "dst_port",
        service_name("dst_port").alias("service"),
        "port_connections",
        percent(F.col("port_connections"), F.col("connections")).alias("port_pct"),
        "port_unique_sources",
    )
    return report.orderBy(F.desc("connections"), key, "port_rank")


# --- distinct sources kept per day -----------------------------------------------------

#: A sketch of 2 ** 12 registers misses by 1.04 / 64 of the number, as a standard deviation.
SKETCH_BITS = 12
DAY, SKETCH = "day", "sources"


def daily_sources(df: DataFrame, key: str) -> DataFrame:
    """Per day of the log's own clock and value of ``key``: its rows and a sketch of its sources.

    A few KB per row whatever the traffic. Kept day by day, reports over any days are made
    of these alone; rows without a time have day NULL.
    """
    require_columns(df, key, "src_ip", "timestamp_local")
    known = df.where(F.col(key).isNotNull())
    return known.groupBy(F.to_date("timestamp_local").alias(DAY), key).agg(
        _rows(df).alias("connections"), F.hll_sketch_agg("src_ip", SKETCH_BITS).alias(SKETCH)
    )


def merged_locations(days: DataFrame, key: str, limit: int = TOP_LOCATIONS) -> DataFrame:
    """``top_locations`` of stored days; ``unique_sources`` is an estimate."""
    merged = days.groupBy(key).agg(F.sum("connections").alias("connections"), F.hll_union_agg(SKETCH).alias(SKETCH))
    top = merged.orderBy(F.desc("connections"), key).limit(limit)
    return top.select(key, "connections", F.hll_sketch_estimate(SKETCH).alias("unique_sources"))


def asn_columns(df: DataFrame) -> tuple[str, str] | None:
    """The owner columns of a table, in either naming; None if it has none."""
    for pair in (("asn", "asn_org"), ("geo_asn", "geo_asn_org")):
        if all(name in df.columns for name in pair):
            return pair
    return None


def _with_asn(df: DataFrame) -> DataFrame:
    names = asn_columns(df)
    if names is None:
        raise ValueError("column(s) not found: asn, asn_org")
    asn, org = (F.col(name) for name in names)
    others = [F.col(f"`{name}`") for name in df.columns if name not in ("asn", "asn_org")]
    return df.select(*others, asn.alias("asn"), org.alias("asn_org"))


def top_cities(df: DataFrame, limit: int = TOP_LOCATIONS) -> DataFrame:
    return top_locations(df, "geo_city", limit)


def top_countries(df: DataFrame, limit: int = TOP_LOCATIONS) -> DataFrame:
    return top_locations(df, "geo_country_name", limit)


def top_asns(df: DataFrame, limit: int = TOP_LOCATIONS) -> DataFrame:
    """Owners by number; the name is the least one seen (D8)."""
    return top_locations(_with_asn(df), "asn", limit, label="asn_org")


def city_ports(df: DataFrame, limit: int = TOP_LOCATIONS, ports: int = TOP_PORTS) -> DataFrame:
    return location_ports(df, "geo_city", limit, ports)


def country_ports(df: DataFrame, limit: int = TOP_LOCATIONS, ports: int = TOP_PORTS) -> DataFrame:
    return location_ports(df, "geo_country_name", limit, ports)


def asn_ports(df: DataFrame, limit: int = TOP_LOCATIONS, ports: int = TOP_PORTS) -> DataFrame:
    return location_ports(_with_asn(df), "asn", limit, ports)


# --- threats --------------------------------------------------------------------------


def threat_source_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name.startswith("threat_") and name != MALICIOUS]


def threat_summary(df: DataFrame) -> DataFrame:
    """Malicious connections (rows, not addresses: D11) and their share."""
    require_columns(df, MALICIOUS)
    counts = df.agg(_rows(df, F.col(MALICIOUS)).alias("malicious_connections"), _rows(df).alias("total"))
    return counts.withColumn("pct", percent(F.col("malicious_connections"), F.col("total")))


def threat_by_source(df: DataFrame) -> DataFrame:
    """Hits per blocklist source, sources without hits left out; all sources (D9)."""
    flags = threat_source_columns(df)
    if not flags:
        raise ValueError("no threat source columns found")
    counts = df.agg(
        _rows(df).alias("total"),
        *[_rows(df, F.col(flag)).alias(flag.removeprefix("threat_")) for flag in flags],
    )
    rows = counts.unpivot("total", [flag.removeprefix("threat_") for flag in flags], "source", "hits")
    return rows.where(F.col("hits") > 0).select(
        "source", "hits", percent(F.col("hits"), F.col("total")).alias("pct")
    ).orderBy("source")


def threat_by_country(df: DataFrame, limit: int = TOP_THREATS) -> DataFrame:
    """Countries by malicious connections, with their total and malicious rate."""
    require_columns(df, "geo_country_name", MALICIOUS)
    known = df.where(F.col("geo_country_name").isNotNull())
    counts = known.groupBy("geo_country_name").agg(
        _rows(df, F.col(MALICIOUS)).alias("malicious"), _rows(df).alias("total")
    )
    ranked = counts.where(F.col("malicious") > 0).orderBy(F.desc("malicious"), "geo_country_name")
    return ranked.limit(limit).withColumn("rate", percent(F.col("malicious"), F.col("total")))


def threat_by_asn(df: DataFrame, limit: int = TOP_THREATS) -> DataFrame:
    """(ASN, organisation) by malicious connections; the total is the ASN's."""
    require_columns(df, MALICIOUS)
    known = _with_asn(df).where(F.col("asn").isNotNull())
    counts = known.groupBy("asn", "asn_org").agg(
        _rows(known, F.col(MALICIOUS)).alias("malicious"), _rows(known).alias("n")
    )
    # Few rows by now: one per owner and organisation name.
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy("asn")))
    hits = totals.where((F.col("malicious") > 0) & F.col("asn_org").isNotNull())
    ranked = hits.orderBy(F.desc("malicious"), "asn", "asn_org").limit(limit)
    return ranked.select(
        "asn", "asn_org", "malicious", "total", percent(F.col("malicious"), F.col("total")).alias("rate")
    )


def threat_address_summary(addresses: DataFrame) -> DataFrame:
    """Distinct addresses checked and distinct malicious ones.

    Takes an address table (``operators.enrich.build_address_table``): one row per
    address already, so nothing has to be made distinct.
    """
    require_columns(addresses, "ip", MALICIOUS)
    known = addresses.where(F.col("ip").isNotNull())
    counts = known.agg(
        F.count("*").alias("checked"), F.count_if(F.col(MALICIOUS)).alias("malicious")
    )
    return counts.withColumn("pct", percent(F.col("malicious"), F.col("checked")))


# --- enrichment summary and samples ---------------------------------------------------


def enrichment_summary(df: DataFrame) -> DataFrame:
    """Resolved geography, resolved owners and malicious rows, one row in all."""
    require_columns(df, "geo_country_name", "geo_asn")
    measures = {
        "geo_resolved": F.count("geo_country_name"),
        "asn_resolved": F.count("geo_asn"),
    }
    if MALICIOUS in df.columns:
        measures["malicious_connections"] = F.count_if(F.col(MALICIOUS))
    counts = df.agg(F.count("*").alias("total"), *[m.alias(name) for name, m in measures.items()])
    shares = [percent(F.col(name), F.col("total")).alias(f"{name}_pct") for name in measures]
    return counts.select("total", *measures, *shares)


def leading_countries(df: DataFrame, limit: int = 3) -> DataFrame:
    """The most frequent countries with their share of all rows."""
    counts = value_distribution(df, "geo_country_name")
    return counts.orderBy(F.desc("connections"), "geo_country_name").limit(limit)


def _first(df: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """The first rows by ``order``, NULL last; ties are broken by all other columns that can be sorted."""
    ties = [f.name for f in df.schema if f.name not in order and f.dataType.typeName() not in ("map", "variant")]
    return df.orderBy(*[F.asc_nulls_last(name) for name in [*order, *ties]]).limit(limit)


def sample_parsed(df: DataFrame, limit: int = 5, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """The first rows by time."""
    return _first(df, limit, order)


def sample_enriched(
    df: DataFrame,
    ip_column: str = "src_ip",
    limit: int = 5,
    order: Sequence[str] = ("timestamp",),
    per_kind: int | None = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The first rows by time: the address, then the first geo and threat columns.

    ``per_kind`` limits how many columns of either kind are shown (None: all).
    """
    shown = [ip_column]
    for prefix in ("geo_", "threat_"):
        shown += [name for name in df.columns if name.startswith(prefix)][:per_kind]
    return _first(df, limit, order).select(*keep, *shown)


def sample_malicious(
    df: DataFrame,
    ip_column: str = "src_ip",
    limit: int = 5,
    order: Sequence[str] = ("timestamp",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """The first malicious rows by time: the address and all threat columns."""
    require_columns(df, MALICIOUS)
    flags = [name for name in df.columns if name.startswith("threat_")]
    return _first(df.where(F.col(MALICIOUS)), limit, order).select(*keep, ip_column, *flags)
