"""Longest match by disjoint ranges: one probe per address for any number of network tables.

Networks nest or are apart, never overlap in part. A sweep over their boundaries turns each
table into ranges that don't overlap and know the innermost network around them:

1. Every network opens at its first address and closes at its last. Networks are cut at
   buckets of ``BITS`` leading bits, so that the sweep runs in parallel; what is shorter than
   a bucket is repeated in each bucket that it covers, ``BITS * 2 ** BITS`` rows at most.
2. The running sum of opens and closes is the depth. After a close, the innermost network is
   the last one that opened at the depth that is left.
3. Addresses join the sorted boundaries of their bucket and take the last state before them,
   of all tables at once. An address is one row; how many lengths its tables have is of no
   account.

An IPv4 bucket has at most ``2 ** (32 - BITS)`` different addresses. IPv6 buckets have no such
bound, so their addresses are dealt to ``SALTS`` parts, each with its own copy of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallscope.functions.addresses import masked

BITS = 12
SALTS = 8

# Left-aligned halves compare as unsigned numbers once their sign bit is flipped.
FLIP = "shiftleft(1L, 63)"
LAST = "9223372036854775807L"
_BUCKET = ["family", "bucket"]
_REST = 64 - BITS


def bucket_of(hi: str = "hi") -> str:
    return f"CAST(shiftrightunsigned({hi}, {_REST}) AS INT)"


def boundaries(keys: DataFrame) -> DataFrame:
    """Opens and closes of networks (family, plen, hi, lo, layer, score), cut at buckets.

    Adds ``bucket``, ``shut`` (0 opens, 1 closes), ``hi`` and ``lo`` of the boundary in
    comparable form, and ``to_hi``, ``to_lo``, where the state that it leads to begins:
    behind the last address for a close, NULL if that is the end of the bucket.
    """
    copies = f"explode(sequence(0, CAST(shiftleft(1L, greatest({BITS} - plen, 0)) AS INT) - 1)) AS copy"
    cut = keys.selectExpr("family", "layer", "score", "plen", "hi", "lo", copies)
    cut = cut.selectExpr(
        "family", "layer", "score", "plen", f"{bucket_of()} + copy AS bucket",
        f"hi | shiftleft(CAST(copy AS BIGINT), {_REST}) AS hi", "lo", f"greatest(plen, {BITS}) AS __plen",
    )
    keep_hi, keep_lo = masked("__plen", "-1L", "-1L")
    sides = f"""inline(array(
        named_struct('shut', 0, 'hi', hi, 'lo', lo),
        named_struct('shut', 1, 'hi', hi | ~{keep_hi}, 'lo', lo | ~{keep_lo})))"""
    events = cut.selectExpr(*_BUCKET, "layer", "score", "plen", sides)
    last = f"(lo = -1L AND hi | shiftleft(-1L, {_REST}) = -1L)"
    events = events.selectExpr("*", f"shut = 1 AND {last} AS __ends").selectExpr(
        *_BUCKET, "layer", "score", "plen", "shut", f"hi ^ {FLIP} AS hi", f"lo ^ {FLIP} AS lo", "__ends"
    )
    carry = f"CASE WHEN lo = {LAST} THEN {{}} ELSE {{}} END"
    to_hi = f"CASE WHEN shut = 0 THEN hi WHEN NOT __ends THEN {carry.format('hi + 1', 'hi')} END AS to_hi"
    to_lo = f"CASE WHEN shut = 0 THEN lo WHEN NOT __ends THEN {carry.format(FLIP, 'lo + 1')} END AS to_lo"
    return events.selectExpr("* EXCEPT (__ends)", to_hi, to_lo)


def flatten(keys: DataFrame) -> DataFrame:
    """The ranges of each layer as (family, bucket, layer, hi, lo, score).

    A range begins at (hi, lo) and reaches to the next one of its layer and bucket; ``score`` is
    that of the innermost network around it, NULL where there is none.
    """
    events = boundaries(keys).repartition(*_BUCKET)
    # Outer networks open first and close last; an address that is a network opens before it closes.
    order = ["hi", "lo", "shut", F.expr("CASE WHEN shut = 0 THEN plen ELSE -plen END")]
    sweep = Window.partitionBy(*_BUCKET, "layer").orderBy(*order)
    events = events.select(
        "*",
        F.sum(F.expr("1 - 2 * shut")).over(sweep.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
        F.lead("to_hi").over(sweep).alias("next_hi"),
        F.lead("to_lo").over(sweep).alias("next_lo"),
    )
    level = Window.partitionBy(*_BUCKET, "layer", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("shut") == 0, F.struct("score"))
    states = events.withColumn("inner", F.last(opened, ignorenulls=True).over(level))
    # Of several boundaries at one place the last one counts.
    lasting = states.where("to_hi IS NOT NULL AND NOT (to_hi <=> next_hi AND to_lo <=> next_lo)")
    return lasting.select(*_BUCKET, "layer", F.col("to_hi").alias("hi"), F.col("to_lo").alias("lo"), F.col("inner.score").alias("score"))


def probes(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per address of ``prefix_join.with_any_key``: its columns in ``address`` and its place."""
    place = [bucket_of() + " AS bucket", f"hi ^ {FLIP} AS hi", f"lo ^ {FLIP} AS lo"]
    salt = f"CASE WHEN family = 6 THEN CAST(pmod(xxhash64(hi, lo), {salts}) AS INT) ELSE 0 END AS salt"
    whole = f"struct({', '.join(f'`{c}`' for c in keyed.columns)}) AS address"
    return keyed.selectExpr("family", salt, whole, *place)


def match_layers(keyed: DataFrame, keys: DataFrame, layers: int, salts: int = SALTS) -> DataFrame:
    """Addresses of ``with_any_key`` with ``score_0`` ... : for each layer of the networks
    (family, plen, hi, lo, layer, score) the score of the longest one around them, or NULL.
    """
    asked = probes(keyed, salts)
    ranges = flatten(keys)
    copies = F.expr(f"explode(sequence(0, CASE WHEN family = 6 THEN {salts - 1} ELSE 0 END)) AS salt")
    states = [F.when(F.col("layer") == k, F.struct("score")).alias(f"state_{k}") for k in range(layers)]
    ranges = ranges.select(*_BUCKET, copies, "hi", "lo", *states)
    rows = ranges.withColumn("address", F.lit(None).cast(asked.schema["address"].dataType)).unionByName(
        asked, allowMissingColumns=True
    )
    # Without an address first: a range counts for the address that it begins with.
    order = ["hi", "lo", F.col("address").isNotNull()]
    before = Window.partitionBy(*_BUCKET, "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("address", *[_latest(f"state_{k}", before).alias(f"score_{k}") for k in range(layers)])
    return found.where("address IS NOT NULL").select("address.*", *[f"score_{k}" for k in range(layers)])


def _latest(column: str, before: Window) -> Column:
    return F.last(column, ignorenulls=True).over(before)["score"]
