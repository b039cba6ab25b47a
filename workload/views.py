"""Firewall-log inputs derived from the test tables.

The same SQL text runs in Spark and in DuckDB; only the time format differs. The
views cover junk lines, both kinds of offset, impossible dates, padded lines,
IPv6 and dotted-interface lines, private, documentation, multicast, invalid and
truncated addresses, nested and unmapped networks, and messy feed text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wallscope.operators.parse import parse_lines
from wallscope.session import materialize, scratch_path
from wallscope.sources import feeds
from wallscope.sources.networks import asn_networks, geo_networks

TABLES = ("region", "nation", "customer", "supplier", "events")

SPARK_TIME = """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")"""
DUCKDB_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"

LINES = """
SELECT event_id, CASE
 WHEN event_id % 53 = 0 THEN 'This is not a valid log line'
 ELSE concat(
  CASE WHEN event_id % 59 = 0 THEN '   ' WHEN event_id % 61 = 0 THEN 'x ' ELSE '' END,
  CASE WHEN event_id % 67 = 0 THEN '2025-13-17T14:58:10' ELSE {time} END,
  CASE WHEN event_id % 71 = 0 THEN '-05:00' WHEN event_id % 2 = 0 THEN '+00:00' ELSE '+02:00' END,
  ' fw', user_id % 3, '.example.net pf[', 1000 + user_id % 7, '] 00:00:0', event_id % 10,
  '.606036 rule 7.qLmn.', user_id % 50, '/0(match): ',
  CASE WHEN event_id % 5 = 0 THEN 'pass' ELSE 'block' END, ' ',
  CASE WHEN event_id % 3 = 0 THEN 'out' ELSE 'in' END, ' on ',
  CASE WHEN event_id % 73 = 0 THEN 'vlan0.100' ELSE concat('igb', user_id % 2) END, ': ',
  CASE WHEN event_id % 79 = 0 THEN concat('2001:db8::', user_id)
       WHEN event_id % 23 = 0 THEN concat('10.0.', event_id % 4, '.', 1 + user_id % 250)
       WHEN event_id % 29 = 0 THEN concat('203.0.113.', user_id % 250)
       WHEN event_id % 41 = 0 THEN concat('224.0.0.', user_id % 250)
       WHEN event_id % 43 = 0 THEN '999.1.1.1'
       ELSE concat(20 + user_id % 30, '.', (user_id * 7) % 256, '.', event_id % 3, '.', 1 + user_id % 250) END,
  CASE WHEN event_id % 47 = 0 THEN concat(' > 81.17.24.', event_id % 250, ': ICMP echo request, id 1, seq 2, length 64')
  ELSE concat('.', 1024 + event_id % 4000, ' > 81.17.24.', event_id % 250, '.',
   CASE event_id % 7 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 443 WHEN 3 THEN 3389 WHEN 4 THEN 8080 WHEN 5 THEN 443 ELSE 5984 END, ': ',
   CASE event_type
    WHEN 'click' THEN concat('Flags [S], seq ', 305419896 + event_id, ', win 1024, options [mss 1460], length 0')
    WHEN 'view' THEN concat('UDP, length ', CASE WHEN event_id % 83 = 0 THEN '99999999999999999999' ELSE concat('', event_id % 1400) END)
    WHEN 'error' THEN 'ICMP 81.17.24.1 udp port 53 unreachable, length 36'
    WHEN 'signup' THEN concat('Flags [P.], seq ', event_id, ':', event_id + 9, ', ack 1, win 512, length 9')
    ELSE 'igmp query v2' END) END,
  CASE WHEN event_id % 59 = 0 THEN '  ' ELSE '' END)
 END AS value FROM events
"""

# A /8 per nation, nested /12 networks per supplier bucket, a /27 per region among
# the destination addresses; first octets 45-49 are unmapped.
GEO = """
SELECT concat(20 + n_nationkey, '.0.0.0') AS net, 8 AS plen, concat('C', n_nationkey) AS country_code,
 n_name AS country_name, CAST(NULL AS string) AS city, CAST(n_nationkey AS double) AS latitude, CAST(-n_nationkey AS double) AS longitude,
 CAST(100 + n_nationkey AS int) AS accuracy_radius, concat('Zone/', r_name) AS time_zone, r_name AS continent,
 CAST(NULL AS string) AS subdivision, CAST(NULL AS string) AS subdivision_code, CAST(NULL AS string) AS postal_code
 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat(20 + s_nationkey, '.', 16 * (s_suppkey % 16), '.0.0'), 12, concat('C', s_nationkey), n_name,
 min(concat('City_', s_suppkey)), CAST(s_nationkey AS double) + 0.5, CAST(s_suppkey % 16 AS double) / 4,
 CAST(s_suppkey % 16 AS int), concat('Zone/', n_name), r_name,
 concat('Province ', s_suppkey % 16), concat('P', s_suppkey % 16), concat(s_nationkey, '-', s_suppkey % 16)
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 GROUP BY s_nationkey, s_suppkey % 16, n_name, r_name
UNION ALL
SELECT concat('81.17.24.', 32 * r_regionkey), 27, concat('R', r_regionkey), concat('LAND_', r_name),
 concat('CAPITAL_', r_regionkey), CAST(r_regionkey AS double), 0.25, 5, 'Zone/Centre', r_name, 'Centre', 'CE', concat('0', r_regionkey) FROM region
"""

# Per nation a /9 and a /10 (the last quarter has no owner); per region an owner
# of an /8 without geography.
ASN = """
SELECT concat(20 + n_nationkey, '.0.0.0') AS net, 9 AS plen, 64500 + 2 * n_nationkey AS asn,
 concat('ORG_', n_nationkey) AS asn_org FROM nation
UNION ALL
SELECT concat(20 + n_nationkey, '.128.0.0'), 10, 64501 + 2 * n_nationkey, concat('ORG_', n_nationkey, 'b') FROM nation
UNION ALL
SELECT concat(45 + r_regionkey, '.0.0.0'), 8, 64700 + r_regionkey,
 CASE WHEN r_regionkey = 0 THEN CAST(NULL AS string) ELSE concat('ORG_R', r_regionkey) END FROM region
"""

FEED_LINES = """
SELECT 'firehol_level1' AS source, CASE
  WHEN c_custkey % 10 = 0 THEN concat('# ', c_name) WHEN c_custkey % 10 = 1 THEN ''
  WHEN c_custkey % 10 = 2 THEN concat('bad_ip_', c_custkey)
  WHEN c_custkey % 10 = 3 THEN concat(20 + c_custkey % 30, '.', (c_custkey * 7) % 256, '.0.0/16   # net')
  WHEN c_custkey % 10 = 4 THEN concat('  ', 20 + c_custkey % 30, '.', (c_custkey * 7) % 256, '.1.7/24')
  WHEN c_custkey % 10 = 5 THEN concat(20 + c_custkey % 30, '.', (c_custkey * 7) % 256, '.', c_custkey % 3, '.', 1 + c_custkey % 250)
  ELSE '203.0.113.0/24' END AS line FROM customer
UNION ALL
SELECT 'emerging_threats', CASE
  WHEN c_custkey % 6 = 0 THEN concat('# ', 20 + c_custkey % 30, '.', (c_custkey * 7) % 256, '.1.', 1 + c_custkey % 250)
  WHEN c_custkey % 6 = 1 THEN concat(20 + c_custkey % 30, '.', (c_custkey * 7) % 256, '.0.', 1 + c_custkey % 250)
  WHEN c_custkey % 6 = 2 THEN '# Malicious IPs' WHEN c_custkey % 6 = 3 THEN ''
  WHEN c_custkey % 6 = 4 THEN '198.51.100.0/24' ELSE 'invalid_ip' END
 FROM customer
"""

# The same for IPv6: a /16, a /32 per nation, a /120 within it; owners of a /40 and of a
# /24 around it; feeds with networks and single addresses.
ADDRESSES6 = """
SELECT DISTINCT concat(CASE WHEN user_id % 5 = 0 THEN '2001:db8' ELSE concat('2a02:', event_id % 30) END, '::', user_id % 1000) AS ip FROM events
"""
GEO6 = """
SELECT '2a02::' AS net, 16 AS plen, 'V6' AS country_code, 'Six' AS country_name, CAST(NULL AS string) AS city, 0.5 AS latitude, 0.25 AS longitude,
 7 AS accuracy_radius, 'Zone/Six' AS time_zone, r_name AS continent, 'Sub' AS subdivision, 'S6' AS subdivision_code, '66' AS postal_code FROM region WHERE r_regionkey = 0
UNION ALL
SELECT concat('2a02:', n_nationkey, '::'), 32, concat('C', n_nationkey), n_name, CAST(NULL AS string), CAST(n_nationkey AS double), -1.5,
 CAST(n_nationkey AS int), concat('Zone/', n_name), r_name, CAST(NULL AS string), concat('N', n_nationkey), concat('6-', n_nationkey)
 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('2a02:', n_nationkey, '::', 1 + n_nationkey % 9, '00'), 120, concat('C', n_nationkey), n_name, concat('City6_', n_nationkey),
 CAST(n_nationkey AS double) + 0.5, 2.5, 1, 'Zone/City', r_name, 'Within', 'WI', CAST(NULL AS string) FROM nation JOIN region ON n_regionkey = r_regionkey
"""
ASN6 = """
SELECT concat('2a02:', n_nationkey, '::') AS net, 40 AS plen, 65000 + n_nationkey AS asn, concat('ORG6_', n_nationkey) AS asn_org FROM nation WHERE n_nationkey % 4 <> 0
UNION ALL
SELECT '2a02::', 24, 65100 + r_regionkey, CAST(NULL AS string) FROM region WHERE r_regionkey = 1
"""
FEED_LINES6 = """
SELECT 'firehol_level1' AS source, CASE n_nationkey % 3 WHEN 0 THEN concat('2a02:', n_nationkey, '::', n_nationkey % 7, '00/120')
  WHEN 1 THEN concat('  2A02:', n_nationkey, '::', 100 + n_nationkey, '  # single') ELSE '2001:db8::/32' END AS line FROM nation
UNION ALL
SELECT 'emerging_threats', concat('# 2a02:', n_nationkey, '::', 200 + n_nationkey) FROM nation
"""

# Address ranges of both families; some end before they begin.
RANGES = """
SELECT event_id, user_id,
 CASE WHEN event_id % 3 = 0 THEN concat('2001:db8::', user_id % 1000)
  ELSE concat(20 + user_id % 30, '.', event_id % 100, '.', (event_id * 7) % 256, '.', event_id % 256) END AS first,
 CASE WHEN event_id % 3 = 0 THEN concat('2001:db8::', event_id % 1000, ':', (event_id * 3) % 1000)
  ELSE concat(20 + user_id % 30, '.', event_id % 100 + user_id % 3, '.', (event_id * 13) % 256, '.', user_id % 256) END AS last
FROM events
"""

# JSON, older and broken metadata texts.
FEED_META = """
SELECT concat('feed_', n_nationkey) AS source, CASE
 WHEN n_nationkey % 7 = 6 THEN 'garbage'
 WHEN n_nationkey % 2 = 0 THEN concat('{{"timestamp": ', 1704067200 + n_nationkey * 7200, '.0, "count": ', 100 + n_nationkey, ', "url": "https://example.com/list_', n_nationkey, '.txt"}}')
 ELSE concat(1704067200 + n_nationkey * 7200, '.5|', 100 + n_nationkey, '|https://example.com/list_', n_nationkey, '.txt') END AS content FROM nation
"""
NOW = 1704240000

# Addresses in several spellings, IPv6 included, with the numbers they stand for.
ADDRESSES = """
SELECT event_id, user_id, CASE event_id % 12
 WHEN 0 THEN concat(20 + user_id % 30, '.', (user_id * 7) % 256, '.', event_id % 3, '.', 1 + user_id % 250)
 WHEN 1 THEN concat('0', user_id % 10, '.2.3.4')
 WHEN 2 THEN concat(user_id % 300, '.', user_id % 7, '.', event_id % 256, '.', event_id % 260)
 WHEN 3 THEN concat('1.2.', user_id % 256)
 WHEN 4 THEN concat('2001:db8::', user_id % 1000)
 WHEN 5 THEN concat('2001:DB8:0:0:0:0:0:', user_id % 1000)
 WHEN 6 THEN concat('::ffff:1.2.', user_id % 256, '.', event_id % 256)
 WHEN 7 THEN concat('2001:db8::', user_id % 1000, '::1')
 WHEN 8 THEN concat(user_id % 1000, ':2:3:4:5:6:7::')
 WHEN 9 THEN concat('fe80::', user_id % 1000, '%eth', event_id % 4)
 WHEN 10 THEN concat('not_an_ip_', user_id)
 ELSE concat(10 + user_id % 3, '.', user_id % 256, '.0.1') END AS ip
FROM events
"""

# Networks in several spellings, valid and invalid.
CIDRS = """
SELECT event_id, user_id, CASE event_id % 10
 WHEN 0 THEN concat(20 + user_id % 30, '.', (user_id * 7) % 256, '.', event_id % 3, '.5/', user_id % 40)
 WHEN 1 THEN concat('10.', user_id % 256, '.0.5/255.255.0.0')
 WHEN 2 THEN concat('10.', user_id % 256, '.0.5/0.0.255.255')
 WHEN 3 THEN concat('10.', user_id % 256, '.0.5/0', user_id % 10)
 WHEN 4 THEN concat('10.', user_id % 256, '.0.5')
 WHEN 5 THEN concat('10.', user_id % 256, '.0.5/')
 WHEN 6 THEN concat('2001:db8::', user_id % 1000, '/128')
 WHEN 7 THEN concat('2001:db8::', user_id % 1000, '/', 100 + user_id % 50)
 WHEN 8 THEN concat('10.', user_id % 256, '.0.5/255.0.255.0')
 ELSE concat('bad_', user_id, '/8') END AS cidr
FROM events
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # The views print and compare UTC times.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            # A test table is one file of one row group; the lines made from it should be many tasks' work.
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            (table.repartition(parts) if name == "events" else table).createOrReplaceTempView(name)
    return spark.sql(sql.format(time=SPARK_TIME))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LINES)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed lines with their ``event_id``, not yet stored."""
    return parse_lines(lines(spark, sf_dir), keep=["event_id"])


def parsed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, stored once: what the parse job hands to the enrichment job."""
    return materialize(parsed(spark, sf_dir), "parsed")


def _records(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return view(spark, sf_dir, sql).selectExpr("concat(net, '/', plen) AS network", "* EXCEPT (net, plen)")


# Network and feed tables are inputs that exist before any log is read: they are
# stored once per session and data folder.
_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def geo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "geo", lambda: geo_networks(_records(spark, sf_dir, GEO)))


def asn_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "asn", lambda: asn_networks(_records(spark, sf_dir, ASN)))


def v6_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """City networks, owner networks and feed entries of IPv6."""
    entries = feeds.load_entries(feeds.normalize(view(spark, sf_dir, FEED_LINES6)))
    return geo_networks(_records(spark, sf_dir, GEO6)), asn_networks(_records(spark, sf_dir, ASN6)), entries


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FEED_LINES)


def feed_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FEED_META)


def threat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(
        spark,
        sf_dir,
        "threats",
        lambda: feeds.load_entries(feeds.normalize(feed_lines(spark, sf_dir))),
    )
