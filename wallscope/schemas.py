"""Fixed schemas of every table the package reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in pairs])


PARSED = _fields(
    ("timestamp", T.TimestampType()),
    ("timestamp_raw", T.StringType()),
    ("timestamp_local", T.TimestampNTZType()),
    ("hostname", T.StringType()),
    ("elapsed", T.StringType()),
    ("rule_info", T.StringType()),
    ("action", T.StringType()),
    ("direction", T.StringType()),
    ("interface", T.StringType()),
    ("src_ip", T.StringType()),
    ("src_port", T.StringType()),
    ("dst_ip", T.StringType()),
    ("dst_port", T.StringType()),
    ("protocol_info", T.StringType()),
    ("tcp_flags", T.StringType()),
    ("protocol", T.StringType()),
    ("length", T.LongType()),
    ("seq", T.LongType()),
    ("win", T.LongType()),
)

# One city record, without the ``geo_`` prefix it gets on enriched rows.
CITY = _fields(
    ("country_code", T.StringType()),
    ("country_name", T.StringType()),
    ("city", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("accuracy_radius", T.IntegerType()),
    ("time_zone", T.StringType()),
    ("continent", T.StringType()),
    ("subdivision", T.StringType()),
    ("subdivision_code", T.StringType()),
    ("postal_code", T.StringType()),
)

# One network-owner record; ``network`` is the owner's network in CIDR text.
ASN = _fields(
    ("asn", T.LongType()),
    ("asn_org", T.StringType()),
    ("network", T.StringType()),
)

# How a network (or a single address, at full prefix length) is keyed: the
# address bits are left-aligned in two signed 64-bit halves, so that one masking
# rule serves both families (IPv4 uses the upper 32 bits of ``hi``).
NETWORK_KEY = _fields(
    ("family", T.IntegerType()),
    ("plen", T.IntegerType()),
    ("hi", T.LongType()),
    ("lo", T.LongType()),
)

GEO_NETWORK = T.StructType(NETWORK_KEY.fields + [T.StructField("network", T.StringType())] + CITY.fields)
ASN_NETWORK = T.StructType(NETWORK_KEY.fields + ASN.fields)
THREAT_NETWORK = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("entry", T.StringType())]
    + NETWORK_KEY.fields
)

FEED_META = _fields(
    ("source", T.StringType()),
    ("timestamp", T.DoubleType()),
    ("count", T.LongType()),
    ("url", T.StringType()),
    ("hash", T.StringType()),
)
