"""DuckDB SQL for every catalogue query, over the same test tables.

Written independently of the Spark code: containment is a BETWEEN join on
numbers, the longest match a row_number, each field its own regular expression.
"""

from __future__ import annotations

import re

from wallscope.operators.enrich import MALICIOUS
from workload import views
from workload.catalog import GEO_SHOWN, SOURCES, THREAT_SHOWN

V4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"

# Fixed value: which lines count as log lines, and their fields.
LINE = (
    r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+\d{2}:\d{2})\s+([\w\.-]+)\s+pf\[\d+\]\s+([\d:.]+)\s+rule\s+"
    r"([\w\d\.\/\(\)]+):\s+(\w+)\s+(\w+)\s+on\s+(\w+):\s+([\d\.]+)\.(\d+)\s+>\s+([\d\.]+)\.(\d+):\s+(.*)"
)
FIELDS = [
    "timestamp_raw", "hostname", "elapsed", "rule_info", "action", "direction", "interface",
    "src_ip", "src_port", "dst_ip", "dst_port", "protocol_info",
]


def v4_number(text: str) -> str:
    octets = [f"TRY_CAST(split_part({text}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)]
    return f"CASE WHEN regexp_matches({text}, '{V4}') THEN {' + '.join(octets)} END"


def _view(sql: str) -> str:
    return sql.format(time=views.DUCKDB_TIME).strip()


def _networks(records: str) -> str:
    return f"""
SELECT *, lo + CAST(power(2, 32 - plen) AS BIGINT) - 1 AS hi, concat(net, '/', plen) AS network
FROM (SELECT *, {v4_number('net')} AS lo FROM {records})"""


# Special-purpose ranges that IPv4 test addresses can meet, longest match first.
_PRIVATE = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
_private_rows = ", ".join(f"('{net}', {plen})" for net, plen in _PRIVATE)
# Names of those ports that test lines can have.
_SERVICES = """
(20, 'FTP-data'), (21, 'FTP'), (22, 'SSH'), (23, 'Telnet'), (25, 'SMTP'), (53, 'DNS'), (80, 'HTTP'),
(110, 'POP3'), (123, 'NTP'), (143, 'IMAP'), (443, 'HTTPS'), (1024, 'Reserved'), (1080, 'SOCKS'), (1443, 'HTTPS-Alt'), (1723, 'PPTP'),
(1735, 'WBEM'), (2017, 'Dyn-Discovery'), (3118, 'WCCP'), (3128, 'HTTP-Proxy'), (3306, 'MySQL'), (3311, 'SSL-Proxy'),
(3322, 'SCCS'), (3333, 'SIP'), (3343, 'MS-Cluster'), (3389, 'RDP'), (3407, 'LDAP-Admin'), (4020, 'HTTP-Alt'),
(4040, 'H2-Alt'), (4145, 'SOCKS-Alt'), (4433, 'HTTPS-Alt'), (4443, 'HTTPS-Alt'), (4445, 'MSRPC'), (8080, 'HTTP-Alt')
"""

_GEO_FIELDS = [
    "country_code", "country_name", "city", "latitude", "longitude", "accuracy_radius", "time_zone",
    "continent", "subdivision", "subdivision_code", "postal_code",
]


def v6_number(text: str) -> str:
    """Of ``group:group::group`` or with an empty last group."""
    group = "CAST(concat('0x0', {}) AS BIGINT)::HUGEINT"
    one, two, last = (group.format(x) for x in (f"split_part({text}, ':', 1)", f"split_part({text}, ':', 2)", f"split_part({text}, '::', 2)"))
    return f"({one} * {1 << 112}::HUGEINT + {two} * {1 << 96}::HUGEINT + {last})"


def _networks6(records: str) -> str:
    return f"""
SELECT *, lo + CAST(power(2, 128 - plen) AS HUGEINT) - 1 AS hi, concat(net, '/', plen) AS network
FROM (SELECT *, {v6_number('net')} AS lo FROM {records})"""


def _cover(ranges: str, keys: str, width: str) -> str:
    """The fewest aligned blocks of ranges (keys, s, e), the largest that fits first: (keys, s, plen)."""
    size = "list_max(list_filter(generate_series(0, 32), lambda k: s % (1::BIGINT << k) = 0 AND s + (1::BIGINT << k) - 1 <= e))"
    return f"""
(WITH RECURSIVE cut AS (
 SELECT {keys}, s, e, {size} AS k FROM {ranges} WHERE s <= e
 UNION ALL
 SELECT {keys}, s, e, {size} AS k FROM (SELECT {keys}, s + (1::BIGINT << k) AS s, e FROM cut) WHERE s <= e)
SELECT {keys}, s, {width} - k AS plen FROM cut)"""


def _dotted(number: str) -> str:
    return "concat_ws('.', " + ", ".join(f"{number} // {256 ** (3 - i)} % 256" for i in range(4)) + ")"


def _longest(networks: str, fields: list[str], addresses: str = "address") -> str:
    return f"""
SELECT ip, plen, {', '.join(fields)} FROM (
 SELECT a.ip, n.*, row_number() OVER (PARTITION BY a.ip ORDER BY n.plen DESC) AS rn
 FROM {addresses} a JOIN {networks} n ON a.num BETWEEN n.lo AND n.hi) WHERE rn = 1"""


# A number whose decimal digits are read as hexadecimal ones.
_HEX = "CAST(concat('0x', {a}) AS BIGINT)"

CTES = {
    "line": _view(views.LINES),
    "stripped": "SELECT event_id, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS line FROM line",
    "matched": f"""
SELECT event_id, regexp_extract(line, '{LINE}', [{', '.join(f"'{f}'" for f in FIELDS)}]) AS f
FROM stripped WHERE regexp_matches(line, '{LINE}')""",
    "fields": "SELECT event_id, " + ", ".join(f"f.{f} AS {f}" for f in FIELDS) + " FROM matched",
    "parsed": r"""
SELECT *, CAST(epoch(local_ts) AS BIGINT)
  - TRY_CAST(substr(timestamp_raw, 21, 2) AS BIGINT) * 3600 - TRY_CAST(substr(timestamp_raw, 24, 2) AS BIGINT) * 60 AS epoch_seconds,
 strftime(local_ts, '%Y-%m-%d %H:%M:%S') AS local_time,
 CAST(hour(local_ts) AS BIGINT) AS local_hour
FROM (SELECT *, TRY_CAST(replace(substr(timestamp_raw, 1, 19), 'T', ' ') AS TIMESTAMP) AS local_ts,
 nullif(regexp_extract(protocol_info, 'Flags \[([^\]]+)\]', 1), '') AS tcp_flags,
 CASE WHEN contains(protocol_info, 'UDP') THEN 'UDP' WHEN contains(protocol_info, 'ICMP') THEN 'ICMP'
  WHEN contains(protocol_info, 'Flags') THEN 'TCP' ELSE 'OTHER' END AS protocol,
 TRY_CAST(nullif(regexp_extract(protocol_info, 'length (\d+)', 1), '') AS BIGINT) AS length,
 TRY_CAST(nullif(regexp_extract(protocol_info, 'seq (\d+)', 1), '') AS BIGINT) AS seq,
 TRY_CAST(nullif(regexp_extract(protocol_info, 'win (\d+)', 1), '') AS BIGINT) AS win
 FROM fields)""",
    "address": f"""
SELECT ip, {v4_number('ip')} AS num FROM
 (SELECT DISTINCT src_ip AS ip FROM parsed UNION SELECT DISTINCT dst_ip FROM parsed)""",
    "private_range": f"SELECT net, plen FROM (VALUES {_private_rows}) AS p(net, plen)",
    "private_net": _networks("private_range"),
    "private_address": "SELECT DISTINCT ip FROM address a JOIN private_net n ON a.num BETWEEN n.lo AND n.hi",
    "geo_record": _view(views.GEO),
    "geo_net": _networks("geo_record"),
    "asn_record": _view(views.ASN),
    "asn_net": _networks("asn_record"),
    "geo_hit": _longest("geo_net", ["network", *_GEO_FIELDS]),
    "asn_hit": _longest("asn_net", ["network", "asn", "asn_org"]),
    "feed_line": _view(views.FEED_LINES),
    "clean_line": f"""
SELECT source, line FROM feed_line WHERE source <> 'emerging_threats'
UNION ALL
SELECT source, text FROM (SELECT source, CASE WHEN starts_with(trim(line), '# ') THEN trim(substr(trim(line), 3)) ELSE trim(line) END AS text
 FROM feed_line WHERE source = 'emerging_threats') WHERE regexp_matches(text, '{V4}')""",
    "word": r"""
SELECT DISTINCT source, regexp_extract(trim(line), '^\S+') AS entry FROM clean_line
WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')""",
    "threat_entry": f"""
SELECT source, entry, plen, num - num % CAST(power(2, 32 - plen) AS BIGINT) AS lo,
 num - num % CAST(power(2, 32 - plen) AS BIGINT) + CAST(power(2, 32 - plen) AS BIGINT) - 1 AS hi
FROM (SELECT source, entry, {v4_number("split_part(entry, '/', 1)")} AS num,
 CASE WHEN contains(entry, '/') THEN TRY_CAST(split_part(entry, '/', 2) AS BIGINT) ELSE 32 END AS plen FROM word)
WHERE num IS NOT NULL AND plen <= 32""",
    "threat_hit": "SELECT DISTINCT a.ip, t.source FROM address a JOIN threat_entry t ON a.num BETWEEN t.lo AND t.hi",
    "address6": f"SELECT ip, {v6_number('ip')} AS num FROM ({_view(views.ADDRESSES6)})",
    "geo6_record": _view(views.GEO6),
    "geo6_net": _networks6("geo6_record"),
    "asn6_record": _view(views.ASN6),
    "asn6_net": _networks6("asn6_record"),
    "geo6_hit": _longest("geo6_net", _GEO_FIELDS, "address6"),
    "asn6_hit": _longest("asn6_net", ["network", "asn", "asn_org"], "address6"),
    "feed6_entry": f"""
SELECT source, {v6_number("split_part(entry, '/', 1)")} AS lo, CASE WHEN contains(entry, '/') THEN CAST(split_part(entry, '/', 2) AS INT) ELSE 128 END AS plen
FROM (SELECT DISTINCT source, split_part(lower(trim(ltrim(line, '# '))), ' ', 1) AS entry FROM ({_view(views.FEED_LINES6)}))""",
    "threat6_hit": "SELECT DISTINCT a.ip, t.source FROM address6 a JOIN feed6_entry t ON a.num BETWEEN t.lo AND t.lo + CAST(power(2, 128 - plen) AS HUGEINT) - 1",
    "range_end": f"""
SELECT event_id, v6, CASE WHEN v6 THEN {_HEX.format(a='user_id % 1000')} ELSE {v4_number('first')} END AS s,
 CASE WHEN v6 THEN {_HEX.format(a='event_id % 1000')} * 65536 + {_HEX.format(a='(event_id * 3) % 1000')} ELSE {v4_number('last')} END AS e
FROM (SELECT *, event_id % 3 = 0 AS v6 FROM ({_view(views.RANGES)}))""",
    "merged_entry": """
SELECT source, CAST(min(lo) AS BIGINT) AS s, CAST(max(hi) AS BIGINT) AS e FROM (
 SELECT *, sum(apart) OVER (PARTITION BY source ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM (
  SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS apart
  FROM threat_entry)) GROUP BY source, part""",
    "profile": f"""
SELECT a.ip, p.ip IS NOT NULL AS is_private,
 {', '.join(f"CASE WHEN p.ip IS NULL THEN g.{c} END AS geo_{c}" for c in _GEO_FIELDS)},
 CASE WHEN p.ip IS NULL THEN CAST(n.asn AS BIGINT) END AS geo_asn,
 CASE WHEN p.ip IS NULL THEN n.asn_org END AS geo_asn_org,
 CASE WHEN p.ip IS NULL THEN n.network END AS geo_network,
 {', '.join(f"a.ip IN (SELECT ip FROM threat_hit WHERE source = '{s}') AS threat_{s}" for s in SOURCES)},
 a.ip IN (SELECT ip FROM threat_hit) AS {MALICIOUS}
FROM address a LEFT JOIN private_address p ON a.ip = p.ip
LEFT JOIN geo_hit g ON a.ip = g.ip LEFT JOIN asn_hit n ON a.ip = n.ip""",
    "enriched": "SELECT e.*, p.* EXCLUDE (ip) FROM parsed e LEFT JOIN profile p ON e.src_ip = p.ip",
    "enriched_dst": "SELECT e.*, p.* EXCLUDE (ip) FROM parsed e LEFT JOIN profile p ON e.dst_ip = p.ip",
    "source_ip": "SELECT DISTINCT src_ip AS ip FROM parsed",
    "service": f"SELECT port, name FROM (VALUES {_SERVICES}) AS s(port, name)",
    "spelled": _view(views.ADDRESSES),
    "cidr_text": _view(views.CIDRS),
    "meta_text": _view(views.FEED_META),
    "meta": r"""
SELECT source, timestamp, count, url, md5(concat(CAST(timestamp AS VARCHAR), ':', count, ':', url)) AS hash
FROM (SELECT source, CASE WHEN json THEN CAST(regexp_extract(content, '"timestamp": ([0-9.]+)', 1) AS DOUBLE)
   WHEN old THEN CAST(split_part(content, '|', 1) AS DOUBLE) END AS timestamp,
  CASE WHEN json THEN CAST(regexp_extract(content, '"count": ([0-9]+)', 1) AS BIGINT)
   WHEN old THEN CAST(split_part(content, '|', 2) AS BIGINT) END AS count,
  CASE WHEN json THEN regexp_extract(content, '"url": "([^"]*)"', 1) WHEN old THEN split_part(content, '|', 3) END AS url
 FROM (SELECT *, starts_with(content, '{') AS json, contains(content, '|') AS old FROM meta_text))""",
}

# NULL, not the hash of nothing, for unusable metadata.
CTES["meta"] = CTES["meta"].replace("md5(concat(", "CASE WHEN timestamp IS NOT NULL THEN md5(concat(").replace(
    ", url)) AS hash", ", url)) END AS hash"
)


def with_ctes(sql: str) -> str:
    """Prefix the common table expressions that ``sql`` needs, in order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in CTES.keys() - needed:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                pending.append(CTES[name])
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()


PARSED_SHOWN = [
    "epoch_seconds", "local_time", *FIELDS, "tcp_flags", "protocol", "length", "seq", "win",
]
_parsed = ", ".join(PARSED_SHOWN)
_geo = ", ".join(GEO_SHOWN)
_threat = ", ".join(THREAT_SHOWN)
_flags = [f"threat_{s}" for s in SOURCES]


def pct(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / {whole} * 100"


def _distribution(column: str, table: str = "parsed") -> str:
    share = pct("count(*)", f"(SELECT count(*) FROM {table})")
    return f"SELECT {column}, count(*) AS connections, {share} AS pct FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"


def _service(port: str) -> str:
    return f"coalesce((SELECT name FROM service s WHERE s.port = TRY_CAST({port} AS INT)), 'Unknown')"


def _top(key: str, extra: str = "") -> str:
    return f"""SELECT {key}, count(*) AS connections, count(DISTINCT src_ip) AS unique_sources{extra} FROM enriched
 WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY connections DESC, {key} LIMIT 10"""


def _ports(key: str, name: str) -> str:
    return f"""
SELECT {key} AS {name}, connections, port_rank, dst_port, {_service('dst_port')} AS service, port_connections,
 {pct('port_connections', 'connections')} AS port_pct, port_unique_sources
FROM (SELECT e.{key}, t.connections, e.dst_port, count(*) AS port_connections,
  count(DISTINCT e.src_ip) AS port_unique_sources,
  row_number() OVER (PARTITION BY e.{key} ORDER BY count(*) DESC, e.dst_port) AS port_rank
 FROM enriched e JOIN (SELECT {key}, count(*) AS connections FROM enriched WHERE {key} IS NOT NULL
  GROUP BY {key} ORDER BY connections DESC, {key} LIMIT 10) t ON e.{key} = t.{key}
 GROUP BY e.{key}, t.connections, e.dst_port) WHERE port_rank <= 5"""


# The numbers behind the spellings of ``views.ADDRESSES``; decimal digits read as
# hexadecimal ones.
def _digits(value: str) -> str:
    return f"({value} // 100 * 256 + {value} // 10 % 10 * 16 + {value} % 10)"


def _signed(high_word: str) -> str:
    """A 32-bit number in the upper half of a signed 64-bit word."""
    return f"CAST(CASE WHEN {high_word} >= 2147483648 THEN {high_word} - 4294967296 ELSE {high_word} END AS BIGINT) * 4294967296"


_U = "(user_id % 1000)"
_DB8 = 0x20010DB8 << 32
_HEAD = f"CAST(CASE WHEN {_digits(_U)} >= 32768 THEN {_digits(_U)} - 65536 ELSE {_digits(_U)} END AS BIGINT) * 281474976710656"
_FE80 = (0xFE80 << 48) - (1 << 64)

ADDRESS_NUMBERS = f"""
SELECT event_id, ip, k, CAST(CASE WHEN num IS NOT NULL THEN 4 WHEN k BETWEEN 4 AND 9 THEN 6 END AS BIGINT) AS family,
 CASE WHEN num IS NOT NULL THEN {_signed('num')} WHEN k IN (4, 5, 7) THEN {_DB8} WHEN k = 6 THEN 0
  WHEN k = 8 THEN {_HEAD} + {0x000200030004} WHEN k = 9 THEN CAST({_FE80} AS BIGINT) END AS hi,
 CASE WHEN num IS NOT NULL THEN 0 WHEN k IN (4, 5, 9) THEN {_digits(_U)}
  WHEN k = 6 THEN {0xFFFF << 32} + {0x0102 << 16} + (user_id % 256) * 256 + event_id % 256
  WHEN k = 7 THEN 1
  WHEN k = 8 THEN {0x0005000600070000} END AS lo
FROM (SELECT *, event_id % 12 AS k, {v4_number('ip')} AS num FROM spelled)"""
# 2001:db8::N::1 has two gaps and is no address.
ADDRESS_NUMBERS = ADDRESS_NUMBERS.replace("k BETWEEN 4 AND 9", "k IN (4, 5, 6, 8, 9)").replace(
    "WHEN k IN (4, 5, 7) THEN", "WHEN k IN (4, 5) THEN"
).replace("  WHEN k = 7 THEN 1\n", "")

_TEN = "(10 * 256 + user_id % 256) * 65536"
CIDR_NUMBERS = f"""
SELECT event_id, cidr, CASE WHEN plen IS NULL THEN NULL WHEN k IN (6, 7) THEN 6 ELSE 4 END AS family, plen,
 CASE WHEN plen IS NULL THEN NULL WHEN k IN (6, 7) THEN {_DB8} ELSE {_signed('cut')} END AS hi,
 CASE WHEN plen IS NULL THEN NULL WHEN k IN (6, 7) THEN {_digits(_U)} - {_digits(_U)} % CAST(power(2, 128 - plen) AS BIGINT) ELSE 0 END AS lo
FROM (SELECT *, num - num % CAST(power(2, 32 - least(plen, 32)) AS BIGINT) AS cut FROM
 (SELECT event_id, user_id, cidr, event_id % 10 AS k,
  CASE WHEN event_id % 10 = 0 THEN {v4_number("split_part(cidr, '/', 1)")} ELSE {_TEN} + 5 END AS num,
  CASE event_id % 10 WHEN 0 THEN CASE WHEN user_id % 40 <= 32 THEN user_id % 40 END
   WHEN 1 THEN 16 WHEN 2 THEN 16 WHEN 3 THEN user_id % 10 WHEN 4 THEN 32 WHEN 6 THEN 128
   WHEN 7 THEN CASE WHEN 100 + user_id % 50 <= 128 THEN 100 + user_id % 50 END END AS plen FROM cidr_text))"""

# Whole numbers come out as BIGINT, as Spark's counts do.
_PLEN = "CAST(plen AS BIGINT) AS plen"

_QUERIES = {
    "src_text": f"SELECT {_parsed} FROM parsed",
    "parse_lines": f"SELECT event_id, {_parsed} FROM parsed",
    "parse_rejects": f"SELECT event_id, line FROM stripped WHERE NOT regexp_matches(line, '{LINE}')",
    "parse_counts": f"SELECT count(*) AS lines, count(*) FILTER (regexp_matches(line, '{LINE}')) AS parsed, count(*) FILTER (NOT regexp_matches(line, '{LINE}')) AS rejected FROM stripped",
    "stream_rejects": f"SELECT 'parsed' AS kind, timestamp_raw AS text FROM parsed UNION ALL SELECT 'rejected', line FROM stripped WHERE NOT regexp_matches(line, '{LINE}')",
    "parse_time": "SELECT event_id, timestamp_raw, epoch_seconds, local_hour FROM parsed",
    "parse_proto": "SELECT event_id, protocol, tcp_flags, length, seq, win FROM parsed",
    "sink_roundtrip": f"SELECT event_id, {_parsed} FROM parsed",
    "row_total": "SELECT count(*) AS rows FROM parsed",
    "ip_validate": f"SELECT event_id, ip, family IS NOT NULL AS is_valid FROM ({ADDRESS_NUMBERS})",
    "ip_to_num": f"SELECT event_id, ip, family, CAST(CAST(hi AS BIGINT) AS VARCHAR) AS hi, CAST(CAST(lo AS BIGINT) AS VARCHAR) AS lo FROM ({ADDRESS_NUMBERS})",
    "cidr_parse": f"SELECT event_id, cidr, CAST(family AS BIGINT) AS family, {_PLEN}, CAST(CAST(hi AS BIGINT) AS VARCHAR) AS hi, CAST(CAST(lo AS BIGINT) AS VARCHAR) AS lo FROM ({CIDR_NUMBERS})",
    "ip_private": f"""
SELECT DISTINCT a.ip, coalesce(a.family = 6 OR n.net IS NOT NULL, false) AS is_private
FROM (SELECT ip, family, {v4_number('ip')} AS num FROM ({ADDRESS_NUMBERS})) a
LEFT JOIN private_net n ON a.num BETWEEN n.lo AND n.hi""",
    "service_name": f"SELECT port, {_service('p.port')} AS service FROM (SELECT src_port AS port FROM parsed UNION SELECT dst_port FROM parsed) p",
    "distinct_ips": "SELECT DISTINCT src_ip AS ip FROM parsed",
    "feed_load": f"SELECT source, entry, {_PLEN}, {_signed('lo')} AS hi FROM threat_entry WHERE source = 'firehol_level1'",
    "feed_ip_only": "SELECT source, line FROM clean_line WHERE source = 'emerging_threats'",
    "feed_union": f"SELECT source, entry, {_PLEN}, {_signed('lo')} AS hi FROM threat_entry",
    "feed_meta": "SELECT source, timestamp, count, url, hash FROM meta",
    "feed_stale": f"""
SELECT source, timestamp IS NOT NULL AS usable, CAST({views.NOW} AS DOUBLE) - timestamp AS age_seconds,
 coalesce(CAST({views.NOW} AS DOUBLE) - timestamp > 86400, true) AS needs_refresh FROM meta""",
    "feed_info": f"""
SELECT source, count, strftime(make_timestamp(CAST(timestamp * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS updated, url, age_seconds,
 concat(CASE WHEN age_seconds >= 86400 THEN concat(age_seconds // 86400, CASE WHEN age_seconds // 86400 = 1 THEN ' day, ' ELSE ' days, ' END) ELSE '' END,
  age_seconds % 86400 // 3600, ':', lpad(CAST(age_seconds % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(age_seconds % 60 AS VARCHAR), 2, '0')) AS age
FROM (SELECT *, CAST(floor({views.NOW} - timestamp) AS BIGINT) AS age_seconds FROM meta WHERE timestamp IS NOT NULL)""",
    "feed_counts": "SELECT source, count(*) AS entries, (SELECT count(*) FROM threat_entry) AS total_entries FROM threat_entry GROUP BY source",
    "feed_publish": f"""
SELECT t.source, t.entry, m.timestamp, m.n AS count, md5(concat(CAST(m.timestamp AS VARCHAR), ':', m.n, ':', m.url)) AS hash
FROM threat_entry t JOIN (SELECT source, count(*) AS n, CAST(CASE source WHEN 'firehol_level1' THEN {views.NOW} ELSE {views.NOW + 60} END AS DOUBLE) AS timestamp,
 CASE source WHEN 'firehol_level1' THEN 'https://raw.githubusercontent.com/firehol/blocklist-ipsets/master/firehol_level1.netset'
  ELSE 'https://rules.emergingthreats.net/fwrules/emerging-Block-IPs.txt' END AS url FROM threat_entry GROUP BY source) m ON t.source = m.source""",
    "enrich_v6": f"""
SELECT a.ip, p AS is_private, {', '.join(f"CASE WHEN NOT p THEN g.{c} END AS geo_{c}" for c in _GEO_FIELDS)},
 CASE WHEN NOT p THEN CAST(n.asn AS BIGINT) END AS geo_asn, CASE WHEN NOT p THEN n.asn_org END AS geo_asn_org, CASE WHEN NOT p THEN n.network END AS geo_network,
 {', '.join(f"a.ip IN (SELECT ip FROM threat6_hit WHERE source = '{s}') AS threat_{s}" for s in SOURCES)}, a.ip IN (SELECT ip FROM threat6_hit) AS {MALICIOUS}
FROM (SELECT *, starts_with(ip, '2001:db8:') AS p FROM address6) a LEFT JOIN geo6_hit g ON a.ip = g.ip LEFT JOIN asn6_hit n ON a.ip = n.ip""",
    "threat_cidr_v6": "SELECT ip, source FROM threat6_hit",
    "range_cover": f"""
SELECT event_id, CASE WHEN v6 THEN concat('2001:db8::', CASE WHEN s >= 65536 THEN printf('%x:%x', s // 65536, s % 65536) WHEN s > 0 THEN printf('%x', s) ELSE '' END)
 ELSE {_dotted('s')} END || '/' || plen AS network FROM {_cover('range_end', 'event_id, v6', 'CASE WHEN v6 THEN 128 ELSE 32 END')}""",
    "feed_collapse": f"SELECT source, {_dotted('s')} || '/' || plen AS entry FROM {_cover('merged_entry', 'source', '32')}",
    "threat_collapsed": "SELECT h.ip, h.source FROM threat_hit h WHERE h.ip IN (SELECT ip FROM source_ip)",
    "feed_replay": "SELECT h.ip, h.source FROM threat_hit h WHERE h.ip IN (SELECT ip FROM source_ip)",
    "feed_meta_json": "SELECT source, timestamp, count, url, hash FROM meta WHERE timestamp IS NOT NULL",
    "geo_lpm": f"SELECT s.ip, {_PLEN}, network, country_name, city FROM source_ip s LEFT JOIN geo_hit g ON s.ip = g.ip",
    "asn_lpm": f"SELECT s.ip, {_PLEN}, network, CAST(asn AS BIGINT) AS asn, asn_org FROM source_ip s LEFT JOIN asn_hit g ON s.ip = g.ip",
    "enrich_geo": f"SELECT event_id, src_ip, {_geo} FROM enriched",
    "enrich_dst": f"SELECT event_id, dst_ip, {_geo} FROM enriched_dst",
    "batch_lookup": "SELECT event_id AS pos, src_ip AS ip, "
    + ", ".join(f"{c} AS {c.removeprefix('geo_')}" for c in GEO_SHOWN)
    + " FROM enriched",
    "geo_counts": "SELECT geo_country_name, geo_city, count(*) AS count FROM enriched GROUP BY ALL",
    "threat_exact": "SELECT DISTINCT s.ip, t.source FROM source_ip s JOIN threat_entry t ON s.ip = t.entry",
    "threat_cidr": "SELECT h.ip, h.source FROM threat_hit h WHERE h.ip IN (SELECT ip FROM source_ip)",
    "threat_any": f"SELECT ip, {MALICIOUS} AS is_malicious FROM profile WHERE ip IN (SELECT ip FROM source_ip)",
    "threat_verdict_map": " UNION ALL ".join(
        f"SELECT ip, '{s}' AS source, threat_{s} AS flag FROM profile WHERE ip IN (SELECT ip FROM source_ip)"
        for s in SOURCES
    ),
    "enrich_threat": f"SELECT event_id, src_ip, {_threat} FROM enriched",
    "threat_summary": f"""
SELECT count(*) FILTER ({MALICIOUS}) AS malicious_connections, count(*) AS total,
 {pct(f'count(*) FILTER ({MALICIOUS})', 'count(*)')} AS pct FROM enriched""",
    "threat_by_source": f"""
SELECT source, hits, {pct('hits', '(SELECT count(*) FROM enriched)')} AS pct FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{s}' AS source, count(*) FILTER (threat_{s}) AS hits FROM enriched" for s in SOURCES
    )
    + ") WHERE hits > 0",
    "threat_by_country": f"""
SELECT geo_country_name, malicious, total, {pct('malicious', 'total')} AS rate FROM (
 SELECT geo_country_name, count(*) FILTER ({MALICIOUS}) AS malicious, count(*) AS total FROM enriched
 WHERE geo_country_name IS NOT NULL GROUP BY geo_country_name)
WHERE malicious > 0 ORDER BY malicious DESC, geo_country_name LIMIT 10""",
    "threat_by_asn": f"""
SELECT m.asn, m.asn_org, m.malicious, t.total, {pct('m.malicious', 't.total')} AS rate
FROM (SELECT geo_asn AS asn, geo_asn_org AS asn_org, count(*) AS malicious FROM enriched
 WHERE {MALICIOUS} AND geo_asn IS NOT NULL AND geo_asn_org IS NOT NULL GROUP BY ALL) m
JOIN (SELECT geo_asn AS asn, count(*) AS total FROM enriched GROUP BY geo_asn) t ON m.asn = t.asn
ORDER BY m.malicious DESC, m.asn, m.asn_org LIMIT 10""",
    "threat_ip_summary": f"""
SELECT count(*) AS checked, count(*) FILTER ({MALICIOUS}) AS malicious, {pct(f'count(*) FILTER ({MALICIOUS})', 'count(*)')} AS pct
FROM profile WHERE ip IN (SELECT ip FROM source_ip)""",
    "enrich_full": f"SELECT event_id, src_ip, dst_port, {_geo}, {_threat} FROM enriched",
    "enrich_hot": f"SELECT event_id, src_ip, dst_port, {_geo}, {_threat} FROM enriched",
    "enrich_summary": f"""
SELECT total, geo_resolved, asn_resolved, malicious_connections, {pct('geo_resolved', 'total')} AS geo_resolved_pct,
 {pct('asn_resolved', 'total')} AS asn_resolved_pct, {pct('malicious_connections', 'total')} AS malicious_connections_pct
FROM (SELECT count(*) AS total, count(geo_country_name) AS geo_resolved, count(geo_asn) AS asn_resolved,
 count(*) FILTER ({MALICIOUS}) AS malicious_connections FROM enriched)""",
    "enrich_top3": _distribution("geo_country_name", "enriched") + " ORDER BY connections DESC, geo_country_name LIMIT 3",
    "sample_parsed": f"SELECT event_id, {_parsed} FROM parsed ORDER BY epoch_seconds NULLS LAST, event_id LIMIT 5",
    "sample_enriched": f"""
SELECT event_id, src_ip, geo_country_code, geo_country_name, geo_city, {MALICIOUS}, {', '.join(_flags)}
FROM enriched ORDER BY epoch_seconds NULLS LAST, event_id LIMIT 20""",
    "sample_malicious": f"""
SELECT event_id, src_ip, {MALICIOUS}, {', '.join(_flags)} FROM enriched WHERE {MALICIOUS}
ORDER BY epoch_seconds NULLS LAST, event_id LIMIT 20""",
    "protocol_dist": _distribution("protocol"),
    "hourly": _distribution("local_hour").replace("SELECT local_hour,", "SELECT local_hour AS hour,", 1),
    "top_src_ports": f"SELECT *, {_service('d.src_port')} AS service FROM ({_distribution('src_port')} ORDER BY connections DESC, src_port LIMIT 10) d",
    "top_src_ips": "SELECT src_ip, count(*) AS connections FROM parsed GROUP BY src_ip ORDER BY connections DESC, src_ip LIMIT 10",
    "interface_dist": _distribution("interface"),
    "interface_direction": f"SELECT interface, direction, count(*) AS connections, {pct('count(*)', '(SELECT count(*) FROM parsed)')} AS pct FROM parsed GROUP BY interface, direction",
    "top_cities": _top("geo_city"),
    "top_countries": _top("geo_country_name"),
    "countries_by_day": f"SELECT geo_country_name, connections, true AS near FROM ({_top('geo_country_name')})",
    "top_asns": f"SELECT geo_asn AS asn, connections, unique_sources, coalesce(asn_org, 'Unknown') AS asn_org FROM ({_top('geo_asn', ', min(geo_asn_org) AS asn_org')})",
    "city_ports": _ports("geo_city", "geo_city"),
    "country_ports": _ports("geo_country_name", "geo_country_name"),
    "asn_ports": _ports("geo_asn", "asn"),
    "stream_parse": f"SELECT {_parsed} FROM parsed",
    "stream_enrich": f"SELECT timestamp_raw, src_ip, src_port, {_geo}, {_threat} FROM enriched",
}

ORACLES = {name: with_ctes(sql) for name, sql in _QUERIES.items()}
