"""IP address and network text to numeric keys, with Spark's own functions.

The work is split over several projections on purpose: every intermediate value
that is used more than once gets a column of its own, which Catalyst then keeps
separate instead of inlining it many times. Expressions are SQL text, which Spark
parses in one go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"

_GROUP = "[0-9A-Fa-f]{1,4}"
_V6_FULL = rf"^{_GROUP}(?::{_GROUP}){{7}}\z"
_V6_SHORT = rf"^(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?\z"

_SCOPE = r"^([^%/]+)%[^%/]+\z"


def _matches(text: str, pattern: str) -> str:
    return f"{text} RLIKE r'{pattern}'"


def _octet(dotted: str, position: int) -> str:
    return f"CAST(split({dotted}, '[.]')[{position}] AS BIGINT)"


def _v4_bits(dotted: str) -> str:
    """A valid dotted quad in the upper half of a 64-bit word."""
    return "(" + " | ".join(f"shiftleft({_octet(dotted, i)}, {56 - 8 * i})" for i in range(4)) + ")"


def _half(digits: str, start: int) -> str:
    return f"CAST(conv(substring({digits}, {start}, 16), 16, -10) AS BIGINT)"


def _barrier(**columns: str) -> str:
    """The columns as the output of a one-row generator.

    Catalyst copies the expressions of a projection into every filter it pushes
    below it; for the long address expressions that means huge generated code,
    and, below an aggregation, parsing per event instead of per address. Filters
    on a generator's output stay above it.
    """
    fields = ", ".join(f"'{name}', {expression}" for name, expression in columns.items())
    return f"inline(array(named_struct({fields})))"


def with_address_key(df: DataFrame, ip_column: str) -> DataFrame:
    """Add ``family``, ``hi`` and ``lo``; all three NULL for an invalid address.

    Accepts what Python's ``ipaddress`` does: four octets without leading zeros,
    or IPv6 in full, shortened, dotted-tail and scoped form.
    """
    kept = [f"`{name}`" for name in df.columns]
    ip = f"`{ip_column}`"

    # Which form is it? IPv6 text loses its scope here.
    df = df.selectExpr(
        *kept,
        f"CASE WHEN {_matches(ip, V4_PATTERN)} THEN {ip} END AS __v4",
        f"CASE WHEN contains({ip}, ':') THEN regexp_replace({ip}, r'{_SCOPE}', '$1') END AS __v6",
    )

    # A dotted tail becomes two hexadecimal groups; a bad tail invalidates.
    tail = "substring_index(__v6, ':', -1)"
    quad = f"CASE WHEN {_matches(tail, V4_PATTERN)} THEN {tail} END"
    df = df.selectExpr(*kept, "__v4", "__v6", f"CASE WHEN contains(__v6, '.') THEN {quad} END AS __quad")
    a, b, c, d = (_octet("__quad", i) for i in range(4))
    df = df.selectExpr(
        *kept,
        "__v4",
        f"""CASE WHEN contains(__v6, '.')
         THEN concat(left(__v6, length(__v6) - length(__quad)), hex({a} * 256 + {b}), ':', hex({c} * 256 + {d}))
         ELSE __v6 END AS __v6""",
    )

    # "::" stands for at least one zero group; pad to eight groups.
    colons = "(length(__v6) - length(replace(__v6, ':', '')))"
    groups = f"({colons} - CAST(startswith(__v6, '::') AS INT) - CAST(endswith(__v6, '::') AS INT))"
    df = df.selectExpr(
        *kept,
        "__v4",
        f"""split(CASE WHEN {_matches('__v6', _V6_FULL)} THEN __v6
         WHEN {_matches('__v6', _V6_SHORT)} AND {groups} <= 7
         THEN trim(BOTH ':' FROM replace(__v6, '::', concat(':', repeat('0:', 8 - {groups})))) END, ':') AS __groups""",
    )
    padded = ", ".join(f"lpad(__groups[{i}], 4, '0')" for i in range(8))
    df = df.selectExpr(*kept, "__v4", f"concat({padded}) AS __hex")
    return df.selectExpr(
        *kept,
        _barrier(
            family="CASE WHEN __v4 IS NOT NULL THEN 4 WHEN __hex IS NOT NULL THEN 6 END",
            hi=f"coalesce({_v4_bits('__v4')}, {_half('__hex', 1)})",
            lo=f"CASE WHEN __v4 IS NOT NULL THEN 0L ELSE {_half('__hex', 17)} END",
        ),
    )


def _keep_bits(count: str) -> str:
    """A 64-bit word whose ``count`` upper bits are set; clamps outside 0..64."""
    return f"CASE WHEN {count} <= 0 THEN 0L WHEN {count} >= 64 THEN -1L ELSE shiftleft(-1L, 64 - ({count})) END"


def masked(plen: str, hi: str = "hi", lo: str = "lo") -> tuple[str, str]:
    """Both halves of an address with everything behind ``plen`` bits cleared."""
    return f"({hi} & {_keep_bits(plen)})", f"({lo} & {_keep_bits(f'({plen} - 64)')})"


def width_of(family: str) -> str:
    return f"(CASE {family} WHEN 4 THEN 32 WHEN 6 THEN 128 END)"


def _mask_length(mask: str) -> str:
    """Prefix length of a dotted net or host mask given as a 32-bit number."""
    inverse = f"(4294967295 - {mask})"
    return f"""CASE WHEN {inverse} & ({inverse} + 1) = 0 THEN bit_count({mask})
     WHEN {mask} & ({mask} + 1) = 0 THEN 32 - bit_count({mask}) END"""


def with_network_key(df: DataFrame, entry_column: str) -> DataFrame:
    """Add ``family``, ``plen``, ``hi``, ``lo`` for CIDR text or a single address.

    Host bits are masked away (non-strict reading); IPv4 also takes a dotted net
    or host mask. All four columns are NULL when the text is invalid.
    """
    kept = [f"`{name}`" for name in df.columns]
    entry = f"`{entry_column}`"
    df = df.selectExpr(
        *kept,
        f"substring_index({entry}, '/', 1) AS __address",
        f"CASE WHEN contains({entry}, '/') THEN substring({entry}, instr({entry}, '/') + 1) END AS __suffix",
    )
    df = with_address_key(df, "__address")
    df = df.selectExpr(
        *kept,
        "family",
        "hi",
        "lo",
        "__suffix IS NULL AS __single",
        f"CASE WHEN {_matches('__suffix', '^[0-9]+' + chr(92) + 'z')} THEN try_cast(__suffix AS INT) END AS __digits",
        f"""CASE WHEN family = 4 AND {_matches('__suffix', V4_PATTERN)}
         THEN shiftrightunsigned({_v4_bits('__suffix')}, 32) END AS __mask""",
    )
    width = width_of("family")
    df = df.selectExpr(
        *kept,
        "family",
        "hi",
        "lo",
        f"""CAST(CASE WHEN __single THEN {width} WHEN __digits <= {width} THEN __digits
         WHEN __mask IS NOT NULL THEN {_mask_length('__mask')} END AS INT) AS plen""",
    )
    hi, lo = masked("plen")
    valid = "CASE WHEN plen IS NOT NULL THEN {} END"
    return df.selectExpr(
        *kept,
        _barrier(family=valid.format("family"), plen="plen", hi=valid.format(hi), lo=valid.format(lo)),
    )
