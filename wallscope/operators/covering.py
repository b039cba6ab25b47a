"""Address ranges and prefixes: the fewest networks that cover a range, and networks merged.

A range (first, last) splits where its ends first differ. Left of that bit the networks hang
off the path to the first address, right of it off the path to the last, one for each bit of
the path that leaves room. So the cover is an expression of the row, without iteration.

Merging sorts networks by their first address and compares each with the running maximum of
the last addresses before it. That is done per bucket of leading bits; only what touches a
bucket's edge, two ranges at most, is compared across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscope.functions.addresses import masked, with_address_key
from wallscope.operators.ranges import BITS, FLIP, LAST, bucket_of

_END = ["to_hi", "to_lo"]


def _zeros_before(x: str) -> str:
    return f"(64 - length(bin({x})))"


def _zeros_behind(x: str) -> str:
    return f"(length(bin({x})) - length(trim(TRAILING '0' FROM bin({x}))))"


def _zeros_behind_both(hi: str, lo: str) -> str:
    return f"CASE WHEN {lo} <> 0 THEN {_zeros_behind(lo)} WHEN {hi} <> 0 THEN 64 + {_zeros_behind(hi)} ELSE 128 END"


def _bit(p: str, hi: str, lo: str) -> str:
    """Bit ``p`` of an address, counted from 1 at the top."""
    return f"(CASE WHEN {p} <= 64 THEN shiftright({hi}, 64 - {p}) ELSE shiftright({lo}, 128 - {p}) END & 1)"


def cover(ranges: DataFrame) -> DataFrame:
    """A row for each of the fewest networks that cover a range: ``plen``, ``hi``, ``lo``.

    Takes the first address in ``hi``, ``lo`` and the last, bits behind its width set, in
    ``to_hi``, ``to_lo``; keeps all other columns. A range whose first address is behind its
    last gives no row.
    """
    kept = [f"`{c}`" for c in ranges.columns if c not in ("hi", "lo", *_END)]
    ends = ["hi", "lo", *_END]
    differs = f"""CASE WHEN hi <> to_hi THEN {_zeros_before('(hi ^ to_hi)')}
        WHEN lo <> to_lo THEN 64 + {_zeros_before('(lo ^ to_lo)')} ELSE 128 END AS __same"""
    paths = ranges.selectExpr(
        *kept, *ends, differs, f"128 - {_zeros_behind_both('hi', 'lo')} AS __first",
        f"128 - {_zeros_behind_both('(~to_hi)', '(~to_lo)')} AS __last",
    )
    paths = paths.where(f"__same = 128 OR {_bit('(__same + 1)', 'hi', 'lo')} = 0")
    paths = paths.selectExpr(
        *kept, *ends, "__same", "__first <= __same AND __last <= __same AS __whole",
        "greatest(__first, __same + 1) AS __first", "greatest(__last, __same + 1) AS __last",
    )
    # Bits of both paths in reach of a network, those of the path to the last address negative.
    steps = """CASE WHEN __whole THEN array(__same)
        ELSE concat(sequence(__same + 1, __first), sequence(-__same - 1, -__last, -1)) END"""
    found = paths.selectExpr(*kept, *ends, "__same", "__first", "__last", "__whole", f"explode({steps}) AS __step")
    found = found.selectExpr(
        *kept, "__same", "abs(__step) AS plen", "__step >= 0 AS __left",
        "__whole OR __step = __first OR __step = -__last AS __end",
        "CASE WHEN __step >= 0 THEN hi ELSE to_hi END AS hi", "CASE WHEN __step >= 0 THEN lo ELSE to_lo END AS lo",
    )
    found = found.where(f"__end OR (plen > __same + 1 AND {_bit('plen', 'hi', 'lo')} = CASE WHEN __left THEN 0 ELSE 1 END)")
    # Inside the paths a network is the other branch at its last bit.
    branch = "CASE WHEN NOT __end AND {} THEN shiftleft(1L, {} - plen) ELSE 0L END"
    cut_hi, cut_lo = masked("plen")
    return found.selectExpr(
        *kept, "plen", f"{cut_hi} ^ {branch.format('plen <= 64', '64')} AS hi", f"{cut_lo} ^ {branch.format('plen > 64', '128')} AS lo"
    )


def network_text(family: str = "family", plen: str = "plen", hi: str = "hi", lo: str = "lo") -> str:
    """CIDR text of a network key, as SQL; IPv6 in its shortest form."""
    octets = ", '.', ".join(f"shiftrightunsigned({hi}, {56 - 8 * i}) & 255" for i in range(4))
    groups = [f"lower(hex(shiftrightunsigned({half}, {shift}) & 65535))" for half in (hi, lo) for shift in (48, 32, 16, 0)]
    text = f"concat_ws(':', {', '.join(groups)})"
    # The longest run of two or more zero groups, the first of equal ones, is left out.
    runs = [rf"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)\z" for n in range(8, 1, -1)]
    cases = " ".join(
        f"WHEN t RLIKE r'{run}' THEN concat(trim(TRAILING ':' FROM regexp_extract(t, r'{run}', 1)), '::', trim(LEADING ':' FROM regexp_extract(t, r'{run}', 2)))"
        for run in runs
    )
    short = f"element_at(transform(array({text}), t -> CASE {cases} ELSE t END), 1)"
    return f"concat(CASE WHEN {family} = 4 THEN concat({octets}) ELSE {short} END, '/', {plen})"


def range_networks(records: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Records of address ranges as records of networks: ``network`` (CIDR text) in place of both columns.

    Rows with an invalid address, with ends of different families or in wrong order are left out.
    """
    kept = [c for c in records.columns if c not in (first, last)]
    rows = records.select(*[f"`{c}`" for c in kept], F.col(first).alias("__from"), F.col(last).alias("__to"))
    rows = with_address_key(rows, "__from").withColumnsRenamed({"family": "__family", "hi": "__hi", "lo": "__lo"})
    rows = with_address_key(rows, "__to").where("family = __family")
    host = "CASE WHEN family = 4 THEN {} ELSE 0L END"
    ends = rows.selectExpr(
        *[f"`{c}`" for c in kept], "family", "__hi AS hi", "__lo AS lo",
        f"hi | {host.format('4294967295L')} AS to_hi", f"lo | {host.format('-1L')} AS to_lo",
    )
    return cover(ends).selectExpr(*[f"`{c}`" for c in kept], f"{network_text()} AS network")


def _merged(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges (``hi``, ``lo``, ``to_hi``, ``to_lo`` in comparable form) that overlap or touch, as one, per ``keys``."""
    order = Window.partitionBy(*keys).orderBy("hi", "lo", "to_hi", "to_lo")
    before = F.max(F.struct(*_END)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = f"""CASE WHEN before IS NULL THEN 1
        WHEN before.to_lo = {LAST} AND before.to_hi = {LAST} THEN 0
        WHEN before.to_lo = {LAST} THEN CAST(hi > before.to_hi + 1 OR (hi = before.to_hi + 1 AND lo > {FLIP}) AS INT)
        ELSE CAST(hi > before.to_hi OR (hi = before.to_hi AND lo > before.to_lo + 1) AS INT) END"""
    marked = ranges.withColumn("before", before).withColumn("__apart", F.expr(apart))
    grouped = marked.withColumn("__group", F.sum("__apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min(F.struct("hi", "lo")).alias("first"), F.max(F.struct(*_END)).alias("last")]
    return grouped.groupBy(*keys, "__group").agg(*ends).select(*keys, "first.*", "last.*")


def collapse(networks: DataFrame, *keys: str) -> DataFrame:
    """The fewest networks (keys, family, plen, hi, lo) that hold the same addresses, per ``keys``."""
    own = [*keys, "family"]
    copies = f"explode(sequence(0, CAST(shiftleft(1L, greatest({BITS} - plen, 0)) AS INT) - 1)) AS copy"
    cut = networks.selectExpr(*own, "plen", "hi", "lo", copies).selectExpr(
        *own, f"hi | shiftleft(CAST(copy AS BIGINT), {64 - BITS}) AS hi", "lo", f"greatest(plen, {BITS}) AS plen"
    )
    keep_hi, keep_lo = masked("plen", "-1L", "-1L")
    ranges = cut.selectExpr(
        *own, f"{bucket_of()} AS bucket", f"hi ^ {FLIP} AS hi", f"lo ^ {FLIP} AS lo",
        f"(hi | ~{keep_hi}) ^ {FLIP} AS to_hi", f"(lo | ~{keep_lo}) ^ {FLIP} AS to_lo",
    )
    inside = _merged(ranges.distinct(), [*own, "bucket"])
    rest = f"shiftleft(-1L, {64 - BITS})"
    touches = F.expr(f"(lo = {FLIP} AND hi & ~{rest} = 0) OR (to_lo = {LAST} AND to_hi | {rest} = -1L)")
    inside = inside.withColumn("edge", touches)
    across = _merged(inside.where("edge"), own)
    merged = across.unionByName(inside.where("NOT edge").select(*across.columns))
    plain = merged.selectExpr(*own, *[f"{c} ^ {FLIP} AS {c}" for c in ("hi", "lo", *_END)])
    return cover(plain).select(*own, "plen", "hi", "lo")
