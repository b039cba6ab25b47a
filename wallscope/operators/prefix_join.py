"""Joins of addresses to the networks that contain them, as plain hash joins.

An address is compared with a network by masking it to the network's prefix
length, so "contained in" becomes equality on (family, plen, hi, lo). Only prefix
lengths that occur in the network tables are tried: at most 33 + 129 of them.

Most of these probes find nothing. Where only hits are asked for, a Bloom filter of the
network keys drops them before they are shuffled. It is a table of 64-bit words, each key
setting two bits of one word, so building it is an aggregation and testing it is a broadcast
join. The number of words is fixed, which bounds what is broadcast whatever the networks are;
more networks only let more probes pass, and the join behind it decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.functions.addresses import masked, with_address_key
from wallscope.operators.ranges import match_layers
from wallscope.schemas import NETWORK_KEY

KEY = NETWORK_KEY.fieldNames()

# The length of a probe that matches no network: it stands for the address itself.
SELF = -1

# Words of the Bloom filter: about 40 MB as a broadcast table once all of them are in use.
WORDS = 1 << 20


def join_networks(addresses: DataFrame, networks: DataFrame, plen: str, how: str = "inner") -> DataFrame:
    """Join addresses (ip, family, hi, lo, ...) to ``networks`` at the length that
    their column ``plen`` names.

    Adds the networks' columns other than the key. The address columns ``hi`` and
    ``lo`` stay unmasked. In an outer join an address without a length probes for
    itself: it finds nothing, and such addresses do not share one join key.
    """
    values = [name for name in networks.columns if name not in KEY]
    right = networks.selectExpr(*[f"{name} AS __{name}" for name in KEY], *values)
    left = addresses.selectExpr(*addresses.columns, f"coalesce({plen}, {SELF}) AS __length")
    hi, lo = masked(f"(CASE WHEN __length = {SELF} THEN 128 ELSE __length END)")
    matches = F.expr(f"family = __family AND __length = __plen AND {hi} = __hi AND {lo} = __lo")
    return left.join(right, matches, how).select(*addresses.columns, *values)


def with_any_key(addresses: DataFrame) -> DataFrame:
    """Address keys that are never NULL: invalid text has family 0 and, to spread
    it over all partitions, its hash as key.
    """
    return with_address_key(addresses, "ip").selectExpr(
        *[f"`{name}`" for name in addresses.columns],
        "coalesce(family, 0) AS family",
        "coalesce(hi, xxhash64(ip)) AS hi",
        "coalesce(lo, 0L) AS lo",
    )


def _lengths(networks: DataFrame) -> DataFrame:
    """The prefix lengths of each family: 33 + 129 rows at most."""
    return networks.select("family", "plen").distinct()


def _bloom_key(plen: str, hi: str, lo: str) -> list[str]:
    """The word of a network key and its two bits in it."""
    key = f"xxhash64(CAST(family AS INT), CAST({plen} AS INT), {hi}, {lo})"
    bits = [f"shiftleft(1L, CAST(shiftrightunsigned({key}, {start}) & 63 AS INT))" for start in (40, 52)]
    return [f"CAST({key} & {WORDS - 1} AS INT) AS __word", f"{' | '.join(bits)} AS __bits"]


def bloom_filter(networks: DataFrame) -> DataFrame:
    """The Bloom filter of network keys: ``__slot`` and ``__set``, ``WORDS`` rows at most."""
    keys = networks.selectExpr(*_bloom_key("plen", "hi", "lo"))
    return keys.groupBy(F.col("__word").alias("__slot")).agg(F.expr("bit_or(__bits)").alias("__set"))


def lookup_probes(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Addresses with every ``plen`` at which the Bloom filter may have their network."""
    probes = addresses.join(F.broadcast(_lengths(networks)), "family").select(*addresses.columns, "plen")
    asked = probes.selectExpr("*", *_bloom_key("plen", *masked("plen")))
    passed = asked.join(F.broadcast(bloom_filter(networks)), F.expr("__word = __slot AND __bits & __set = __bits"))
    return passed.select(*probes.columns)


def containing_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Every (address, containing network) pair: the address columns, ``plen`` and
    the networks' value columns. Addresses in no network have no row.

    ``networks`` is read three times: for its lengths, its filter and its rows.
    """
    return join_networks(lookup_probes(addresses, networks), networks, "plen")


def longest_match(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Distinct addresses (``ip``, ...) with the record of the longest network that
    contains them, NULL where there is none, and its ``plen``.

    The sweep carries the length only; the record is fetched afterwards by its exact key.
    """
    keyed = with_any_key(addresses)
    keys = networks.select(*KEY, F.lit(0).alias("layer"), F.col("plen").alias("score"))
    best = match_layers(keyed, keys, 1).withColumnRenamed("score_0", "plen")
    found = join_networks(best, networks, "plen", "left")
    return found.drop("family", "hi", "lo")
