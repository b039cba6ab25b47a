"""Geography, network owner and threat verdicts for addresses and log rows.

Enrichment works in two steps. The address table holds one row per distinct
address with everything known about it; all lookups happen there, once per
address. Attaching it to the log is then a single equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from wallscope.functions.addresses import with_address_key, width_of
from wallscope.operators.prefix_join import (
    KEY,
    containing_networks,
    join_networks,
    with_any_key,
)
from wallscope.operators.ranges import match_layers
from wallscope.schemas import ASN, CITY
from wallscope.session import materialize
from wallscope.sources.networks import special_networks

GEO_COLUMNS = [f"geo_{name}" for name in [*CITY.fieldNames(), *ASN.fieldNames()]]
MALICIOUS = "threat_is_malicious"

# The rows of an address with more than this are dealt to several parts, so that no
# task gets all rows of a busy address. The share bounds how many such addresses can
# exist, and with that the size of what is broadcast and copied.
HOT_ROWS = 1_000_000
MAX_HOT_ADDRESSES = 100_000


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {', '.join(missing)}")


def threat_column(source: str) -> str:
    return f"threat_{source}"


def distinct_addresses(events: DataFrame, ip_column: str = "src_ip") -> DataFrame:
    """Distinct non-NULL values of an address column."""
    require_columns(events, ip_column)
    return events.where(F.col(ip_column).isNotNull()).select(F.col(ip_column).alias("ip")).distinct()


def address_counts(events: DataFrame, ip_column: str = "src_ip") -> DataFrame:
    """Rows per address as (ip, n); NULL addresses are counted in a row of their own."""
    require_columns(events, ip_column)
    return events.groupBy(F.col(ip_column).cast("string").alias("ip")).agg(F.count("*").alias("n"))


# --- the address table ----------------------------------------------------------

# What a network key stands for in the combined key table.
_SPECIAL, _GEO, _ASN, _FIRST_SOURCE = range(4)


def _layer(networks: DataFrame, code: Column, score: Column) -> DataFrame:
    return networks.select(*KEY, code.cast("int").alias("layer"), score.cast("int").alias("score"))


def build_address_table(
    addresses: DataFrame,
    geo: DataFrame | None = None,
    asn: DataFrame | None = None,
    threats: DataFrame | None = None,
    sources: Sequence[str] = (),
) -> DataFrame:
    """Look up distinct addresses (``ip`` and any further columns) in all tables.

    One pass: all network tables are layers of one sweep (``ranges``), in which an
    address is one row and gets the longest special, city and owner prefix and a
    flag per blocklist source. The city and owner records are then fetched by their
    exact keys.

    Adds ``is_private``; ``geo_*`` if ``geo`` is given (owner columns stay NULL
    without ``asn``); ``threat_is_malicious`` and ``threat_<source>`` for the
    given sources if ``threats`` is given. Verdicts are never NULL. Private,
    invalid and unknown addresses have NULL geography; the threat verdict does
    not look at private ranges.
    """
    spark = addresses.sparkSession
    plen = F.col("plen")
    layers = [
        _layer(
            special_networks(spark),
            F.lit(_SPECIAL),
            # The low bit tells whether the longest special range is private.
            plen * F.lit(2) + F.col("is_private").cast("int"),
        ),
    ]
    if geo is not None:
        layers.append(_layer(geo, F.lit(_GEO), plen))
        if asn is not None:
            layers.append(_layer(asn, F.lit(_ASN), plen))
    if threats is not None:
        code = F.lit(None)
        for i, source in enumerate(sources):
            code = F.when(F.col("source") == source, F.lit(_FIRST_SOURCE + i)).otherwise(code)
        listed = threats.where(F.col("source").isin(list(sources)))
        layers.append(_layer(listed, code, plen))
    keys = layers[0]
    for layer in layers[1:]:
        keys = keys.unionByName(layer)

    keyed = with_any_key(addresses)
    found = match_layers(keyed, keys, _FIRST_SOURCE + len(sources))
    names = {"special": _SPECIAL, "geo_plen": _GEO, "asn_plen": _ASN}
    names |= {f"hit_{i}": _FIRST_SOURCE + i for i in range(len(sources))}
    summary = found.select(*keyed.columns, *[F.col(f"score_{code}").alias(name) for name, code in names.items()])
    private = F.coalesce(F.col("special") % 2 == 1, F.lit(False))
    flags = [threat_column(source) for source in sources]
    any_hit = F.lit(False)
    for i in range(len(sources)):
        any_hit = any_hit | F.col(f"hit_{i}").isNotNull()
    summary = summary.select(
        *keyed.columns,
        private.alias("is_private"),
        *[F.when(~private, F.col(c)).alias(c) for c in ("geo_plen", "asn_plen")],
        any_hit.alias(MALICIOUS),
        *[F.col(f"hit_{i}").isNotNull().alias(flag) for i, flag in enumerate(flags)],
    )

    added = ["is_private"]
    if geo is not None:
        cities = geo.select(*KEY, *[F.col(c).alias(f"geo_{c}") for c in CITY.fieldNames()])
        summary = join_networks(summary, cities, "geo_plen", "left")
        if asn is not None:
            owners = asn.select(*KEY, *[F.col(c).alias(f"geo_{c}") for c in ASN.fieldNames()])
            summary = join_networks(summary, owners, "asn_plen", "left")
        else:
            empty = [F.lit(None).cast(f.dataType).alias(f"geo_{f.name}") for f in ASN.fields]
            summary = summary.select("*", *empty)
        added += GEO_COLUMNS

    if threats is not None:
        added += [MALICIOUS, *flags]
    return summary.select(*addresses.columns, *added)


def threat_table(counts: DataFrame, threats: DataFrame, sources: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of an address table that ``attach`` needs for verdicts alone: (ip, n,
    ``threat_is_malicious``, ``threat_<source>`` ...) of listed and of busy addresses.

    ``counts`` is a stored table of (ip, n). Addresses that no source lists have the
    verdict False, which ``attach`` gives to what it doesn't find, so they are dropped
    before anything is shuffled. Busy ones stay, so that their rows are spread.
    """
    total = counts.agg(F.sum("n")).first()[0]
    busy = counts.where(F.col("n") > _hot_limit(total, hot_rows, MAX_HOT_ADDRESSES))
    keyed = with_address_key(counts, "ip").select("ip", "n", "family", "hi", "lo")
    listed = threats.where(F.col("source").isin(list(sources))).select(*KEY, "source")
    hits = containing_networks(keyed, listed).select("ip", "n", "source")
    rows = hits.unionByName(busy.select("ip", "n", F.lit(None).cast("string").alias("source")))
    flags = [
        F.coalesce(F.max(F.col("source") == source), F.lit(False)).alias(threat_column(source)) for source in sources
    ]
    any_hit = F.max(F.col("source").isNotNull()).alias(MALICIOUS)
    return rows.groupBy("ip").agg(F.max("n").alias("n"), any_hit, *flags)


# --- attaching it to log rows -----------------------------------------------------


def attach(
    events: DataFrame,
    table: DataFrame,
    ip_column: str,
    columns: Sequence[str],
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT_ADDRESSES,
) -> DataFrame:
    """Left-join ``columns`` of a stored address table (``ip``, ``n``, ...) to events.

    Catalyst sees the size of the stored table and broadcasts it if it is small.
    If it is not, events are shuffled by address. Rows of hot addresses (NULL counts
    as one) are dealt to several parts, each of which has its copy of the address row,
    so the log is read once and no task gets all rows of a busy address. Columns of
    the same name in ``events`` are replaced.
    """
    total, most = table.agg(F.sum("n"), F.max("n")).first()
    limit = _hot_limit(total, hot_rows, max_hot)
    names = [f"`{name}`" for name in events.columns if name not in columns]
    keyed = events.select(*names, F.col(ip_column).cast("string").alias("__ip"))
    lookup = table.select(F.col("ip").alias("__lookup"), *columns)
    # Rows without an address match nothing; their verdict is False all the same.
    values = [
        F.coalesce(F.col(c), F.lit(False)).alias(c) if c.startswith("threat_") else F.col(c) for c in columns
    ]

    # Counts of all addresses add up to the total, so fewer than total/limit,
    # that is at most ``max_hot`` of them, can exceed the limit.
    if (most or 0) <= limit:
        joined = keyed.join(lookup, F.col("__ip") == F.col("__lookup"), "left")
        return joined.select(*names, *values)

    rows = spread_rows(keyed, table, limit)
    copies = F.explode(F.sequence(F.lit(0), _parts(limit) - 1)).alias("__part")
    lookup = table.select(F.col("ip").alias("__lookup"), *columns, copies)
    same = (F.col("__ip") == F.col("__lookup")) & (F.col("__salt") == F.col("__part"))
    return rows.join(lookup, same, "left").select(*names, *values)


def _hot_limit(total: int | None, hot_rows: int, max_hot: int) -> int:
    return max(hot_rows, (total or 0) // max_hot)


def _parts(limit: int) -> Column:
    """In how many parts the rows of an address are dealt, by its count ``n``."""
    return F.ceil(F.col("n") / limit).cast("int")


def spread_rows(keyed: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """Rows with their address in ``__ip``, and ``__salt``: 0, or for addresses with more than
    ``limit`` rows the part that the row's content deals it to.

    A hash of the row is the same in a repeated task. It takes columns of plain types.
    """
    hot = table.where(F.col("n") > limit).select(F.col("ip").alias("__hot"), _parts(limit).alias("__parts"))
    # Fewer than total / limit rows.
    marked = keyed.join(F.broadcast(hot), F.col("__ip").eqNullSafe(F.col("__hot")), "left")
    plain = [f"`{f.name}`" for f in keyed.schema.fields if isinstance(f.dataType, AtomicType)]
    salt = F.expr(f"CASE WHEN __parts IS NULL THEN 0 ELSE CAST(pmod(xxhash64({', '.join(plain)}), __parts) AS INT) END")
    return marked.select(*[f"`{c}`" for c in keyed.columns], salt.alias("__salt"))


def enrich(
    events: DataFrame,
    ip_column: str = "src_ip",
    geo: DataFrame | None = None,
    asn: DataFrame | None = None,
    threats: DataFrame | None = None,
    sources: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Geography, owner and threat columns for every row, in one join.

    ``events`` is read twice (its addresses, then its rows): pass a stored table,
    not a chain of unparsed text. Row count and rows are preserved. Without
    ``sources`` all sources of ``threats`` get a column.
    """
    require_columns(events, ip_column)
    if threats is not None and sources is None:
        sources = source_names(threats)
    counts = address_counts(events, ip_column)
    columns = list(GEO_COLUMNS) if geo is not None else []
    if threats is not None:
        columns += [MALICIOUS, *[threat_column(source) for source in sources]]
    if threats is not None and geo is None:
        table = threat_table(materialize(counts, "counts"), threats, sources, hot_rows)
    else:
        table = build_address_table(counts, geo, asn, threats, sources or ())
    return attach(events, materialize(table, "addresses"), ip_column, columns, hot_rows)


def source_names(threats: DataFrame) -> list[str]:
    """Names of the feeds in a threat table, a handful."""
    return [row.source for row in threats.select("source").distinct().sort("source").collect()]


def enrich_with_geolocation(
    events: DataFrame, geo: DataFrame, ip_column: str = "src_ip", asn: DataFrame | None = None
) -> DataFrame:
    """``geo_*`` columns for every row."""
    return enrich(events, ip_column, geo=geo, asn=asn)


def enrich_with_threats(
    events: DataFrame,
    threats: DataFrame,
    ip_column: str = "src_ip",
    sources: Sequence[str] | None = None,
) -> DataFrame:
    """``threat_is_malicious`` and one flag per source for every row.

    Errors are raised, never swallowed (D3); without any address all flags are
    False (D4).
    """
    return enrich(events, ip_column, threats=threats, sources=sources)


# --- lookups of addresses alone ---------------------------------------------------


def batch_lookup(batch: DataFrame, geo: DataFrame, asn: DataFrame | None = None) -> DataFrame:
    """Look up a numbered batch (``pos``, ``ip``); one row per position.

    Duplicates, misses and invalid addresses keep their positions. Columns carry
    no prefix here.
    """
    require_columns(batch, "pos", "ip")
    found = enrich(batch, "ip", geo=geo, asn=asn)
    plain = [F.col(f"geo_{c}").alias(c) for c in [*CITY.fieldNames(), *ASN.fieldNames()]]
    return found.select("pos", "ip", *plain)


def lookup(
    spark: SparkSession, addresses: Sequence[str], geo: DataFrame, asn: DataFrame | None = None
) -> DataFrame:
    """``batch_lookup`` of a Python list, in list order."""
    batch = spark.createDataFrame(list(enumerate(addresses)), "pos bigint, ip string")
    return batch_lookup(batch, geo, asn).orderBy("pos")


def location_counts(
    events: DataFrame, geo: DataFrame, ip_column: str = "src_ip"
) -> DataFrame:
    """Rows per (country, city), unknown locations included, most frequent first.

    Counts per address are all that is needed, so the lookup result is never
    joined back to the rows.
    """
    table = build_address_table(address_counts(events, ip_column), geo)
    place = ["geo_country_name", "geo_city"]
    counts = table.groupBy(*place).agg(F.sum("n").alias("count"))
    return counts.orderBy(F.desc("count"), *[F.asc_nulls_last(c) for c in place])


def exact_matches(addresses: DataFrame, threats: DataFrame) -> DataFrame:
    """(ip, source) pairs where the address itself is an entry of the feed."""
    single = threats.where(f"plen = {width_of('family')}")
    keys = single.select("source", "family", "hi", "lo").distinct()
    return with_address_key(addresses, "ip").join(keys, ["family", "hi", "lo"]).select("ip", "source")


def network_matches(addresses: DataFrame, threats: DataFrame) -> DataFrame:
    """Distinct (ip, source) pairs where any entry of the feed contains the address."""
    keyed = with_address_key(addresses, "ip").select("ip", "family", "hi", "lo")
    return containing_networks(keyed, threats.select(*KEY, "source")).select("ip", "source").distinct()


def is_malicious(addresses: DataFrame, threats: DataFrame) -> DataFrame:
    """(ip, is_malicious): does any feed contain the address?"""
    sources = source_names(threats)
    table = build_address_table(addresses, threats=threats, sources=sources)
    return table.select("ip", F.col(MALICIOUS).alias("is_malicious"))


def verdicts(addresses: DataFrame, threats: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """(ip, verdicts): a map from every source to its verdict."""
    names = list(sources) if sources is not None else source_names(threats)
    table = build_address_table(addresses, threats=threats, sources=names)
    pairs = [part for s in names for part in (F.lit(s), F.col(threat_column(s)))]
    return table.select("ip", F.create_map(*pairs).alias("verdicts"))
