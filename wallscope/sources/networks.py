"""Network tables: city networks, owner networks and special-purpose ranges.

A network table has the key columns of ``schemas.NETWORK_KEY`` and one row per
network; it is written once per database release and joined by prefix.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallscope.functions.addresses import with_network_key
from wallscope.schemas import ASN, ASN_NETWORK, CITY, GEO_NETWORK, NETWORK_KEY

# Special-purpose ranges (private, reserved, loopback, multicast)
# as Python 3.13's ``ipaddress`` reports them. The longest match decides, so the
# second list cuts public holes into the first.
SPECIAL_NETWORKS = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fe00::/9",
    "ff00::/8",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
    "64:ff9b:1::/48",
]
PUBLIC_EXCEPTIONS = [
    "192.0.0.9/32",
    "192.0.0.10/32",
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
]


def special_networks(spark: SparkSession) -> DataFrame:
    """Key columns and ``is_private`` of the fixed special-purpose ranges."""
    rows = [_key_text(cidr, "true") for cidr in SPECIAL_NETWORKS]
    rows += [_key_text(cidr, "false") for cidr in PUBLIC_EXCEPTIONS]
    columns = ", ".join([*NETWORK_KEY.fieldNames(), "is_private"])
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS special({columns})")


def _key_text(cidr: str, flag: str) -> str:
    """The key of one of the few fixed networks as an SQL row."""
    network = ipaddress.ip_network(cidr)
    bits = int(network.network_address) << (128 - network.max_prefixlen)
    hi, lo = (half - (1 << 64) if half >> 63 else half for half in divmod(bits, 1 << 64))
    return f"({network.version}, {network.prefixlen}, CAST({hi} AS BIGINT), CAST({lo} AS BIGINT), {flag})"


def _one_per_network(keyed: DataFrame, values: list[str]) -> DataFrame:
    """Drop invalid networks; of several records for one network keep the least."""
    keys = NETWORK_KEY.fieldNames()
    record = F.struct(*values)
    unique = keyed.where(F.col("plen").isNotNull()).groupBy(*keys).agg(F.min(record).alias("record"))
    return unique.select(*keys, *[F.col("record")[name].alias(name) for name in values])


def geo_networks(records: DataFrame, cidr_column: str = "network") -> DataFrame:
    """City records with a CIDR column -> network table (``GEO_NETWORK``).

    Fields the records lack are NULL.
    """
    given = set(records.columns)
    fields = [
        (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CITY.fields
    ]
    rows = records.select(F.col(cidr_column).alias("network"), *fields)
    table = _one_per_network(with_network_key(rows, "network"), ["network", *CITY.fieldNames()])
    return table.select(*GEO_NETWORK.fieldNames())


def asn_networks(records: DataFrame, cidr_column: str = "network") -> DataFrame:
    """Owner records with a CIDR column -> network table (``ASN_NETWORK``)."""
    rows = records.select(
        F.col(cidr_column).alias("network"),
        F.col("asn").cast("bigint").alias("asn"),
        F.col("asn_org").cast("string").alias("asn_org"),
    )
    table = _one_per_network(with_network_key(rows, "network"), ASN.fieldNames())
    return table.select(*ASN_NETWORK.fieldNames())
