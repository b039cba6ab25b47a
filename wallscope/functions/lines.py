"""The firewall log line: its pattern and the values read from a matched line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wallscope.functions.text import WHITESPACE, WHITESPACE_CLASS

# Character classes spelled out so that digits, word characters and white space
# mean the Unicode sets of Python's ``\d``, ``\w`` and ``\s``.
_D = r"0-9\p{Nd}"
_W = r"A-Za-z0-9_\p{L}\p{N}"
_S = f"[{WHITESPACE_CLASS}]+"

# The fields of a line in their order, each with its pattern and
# the text up to the next field.
FIELDS = [
    ("timestamp_raw", rf"[{_D}]{{4}}-[{_D}]{{2}}-[{_D}]{{2}}T[{_D}]{{2}}:[{_D}]{{2}}:[{_D}]{{2}}\+[{_D}]{{2}}:[{_D}]{{2}}", _S),
    ("hostname", rf"[{_W}.-]+", rf"{_S}pf\[[{_D}]+\]{_S}"),
    ("elapsed", rf"[{_D}:.]+", rf"{_S}rule{_S}"),
    ("rule_info", rf"[{_W}./()]+", rf":{_S}"),
    ("action", rf"[{_W}]+", _S),
    ("direction", rf"[{_W}]+", rf"{_S}on{_S}"),
    ("interface", rf"[{_W}]+", rf":{_S}"),
    ("src_ip", rf"[{_D}.]+", r"\."),
    ("src_port", rf"[{_D}]+", rf"{_S}>{_S}"),
    ("dst_ip", rf"[{_D}.]+", r"\."),
    ("dst_port", rf"[{_D}]+", rf":{_S}"),
    ("protocol_info", rf"[^{WHITESPACE_CLASS}].*", ""),
]

# The pattern is defined on stripped lines. Instead of stripping every line, white
# space in front is skipped, the last field has to begin with something else, and
# white space behind it is cut off that field only.
# (?d): only a line feed ends a line for ".", as in Python.
LINE_PATTERN = f"(?d)^[{WHITESPACE_CLASS}]*" + "".join(f"({field}){after}" for _, field, after in FIELDS)

# A character that no field but the last can contain.
_SEPARATOR = "\x01"
_JOINED = _SEPARATOR.join(f"${i}" for i in range(1, len(FIELDS) + 1))


def joined_fields(line: Column) -> Column:
    """All fields of a line in one string, by a single run of the pattern.

    A line that does not match comes back unchanged; a match never does, because
    the white space behind its timestamp turns into the separator.
    """
    return F.regexp_replace(line, LINE_PATTERN, _JOINED)


def split_fields(joined: Column) -> Column:
    return F.split(joined, _SEPARATOR, len(FIELDS))


def field(fields: Column, position: int) -> Column:
    text = fields[position]
    is_last = position == len(FIELDS) - 1
    return F.rtrim(text, F.lit(WHITESPACE)) if is_last else text


def _found(pattern: str) -> str:
    return f"nullif(regexp_extract(protocol_info, r'{pattern}', 1), '')"


def _number_after(word: str) -> str:
    """The first number that follows ``word``; NULL beyond 64 bits (D12)."""
    return f"try_cast({_found(word + f' ([{_D}]+)')} AS BIGINT)"


# The wall clock as written, NULL for an impossible date or offset: Python knows
# neither the year 0 nor an offset of a day and more.
_LOCAL_TIME = """CASE WHEN NOT startswith(timestamp_raw, '0000') AND substring(timestamp_raw, 21, 2) < '24'
 THEN try_cast(left(timestamp_raw, 19) AS TIMESTAMP_NTZ) END"""

# The point in time, whatever the session's time zone is.
_INSTANT = f"""CASE WHEN ({_LOCAL_TIME}) IS NOT NULL THEN try_cast(concat(left(timestamp_raw, 19), 'Z') AS TIMESTAMP)
 - make_dt_interval(0, try_cast(substring(timestamp_raw, 21, 2) AS INT), try_cast(substring(timestamp_raw, 24, 2) AS INT)) END"""

# Columns computed from the fields of a line, as SQL over the field names. The
# first protocol that is found wins, case-sensitively.
DERIVED = {
    "timestamp": _INSTANT,
    "timestamp_local": _LOCAL_TIME,
    "tcp_flags": _found(r"Flags \[([^\]]+)\]"),
    "protocol": """CASE WHEN contains(protocol_info, 'UDP') THEN 'UDP' WHEN contains(protocol_info, 'ICMP') THEN 'ICMP'
 WHEN contains(protocol_info, 'Flags') THEN 'TCP' ELSE 'OTHER' END""",
    "length": _number_after("length"),
    "seq": _number_after("seq"),
    "win": _number_after("win"),
}
