"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Every source has a target rate, the mean number of copies of its documents. A document's
number of copies is the inverse of the Poisson distribution at a number between 0 and 1 that
a hash of seed and doc_id gives, so it is the same on every run and machine. Copies are
exploded and then shuffled globally: dealt by a hash key and the text and sorted by the key
within tasks, which splits hot sources, and rows that share a doc_id or have none, like any
others. The rates are one small aggregate; documents move once.

Defined cases: a null source is a source of its own; null, empty and very long texts are
carried like others; rows of one doc_id have one number of copies, and a row without doc_id has
one that its text gives; rows equal in both are dealt alike; a source without a target weight gets
none; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallscope.session import materialize

#: Larger means are drawn as sums of several Poisson numbers, as exp(-mean) must not vanish.
CHUNK = 300.0
#: Beyond this many standard deviations lies less than 2^-52.
TAIL = 9.0
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from the first 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def identity() -> Column:
    """What a document's numbers hang on: its doc_id, or its text if it has none."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("~"), F.md5(text)))


def poisson(mean: Column, u: Column, most: int) -> Column:
    """The least n with P(X <= n) >= u, X being Poisson with ``mean``; no further than ``most``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("n"))
    step = lambda at, i: F.when(
        (at["sum"] < u) & (at["n"] == i - 1),
        F.struct((at["p"] * mean / i).alias("p"), (at["sum"] + at["p"] * mean / i).alias("sum"), i.alias("n")),
    ).otherwise(at)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda at: at["n"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, size: float = 1.0) -> DataFrame:
    """source and rate: mean copies that bring every source to its weight.

    ``weights`` need not add up to 1; without them a source's weight is its number of rows
    to ``power``. ``size`` is the size of the mixture over that of the input.
    """
    spark = docs.sparkSession
    counts = materialize(docs.groupBy("source").count(), "sources")
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("count").cast("double"), power))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
        pairs = counts.alias("c").join(given.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        weighed = pairs.select("c.source", "c.count", "g.weight")
    weight = weighed.agg(F.sum("weight")).first()[0] or 0.0
    total = counts.agg(F.sum("count")).first()[0] or 0
    if not weight:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    return weighed.select("source", (F.lit(size * total / weight) * F.col("weight") / F.col("count")).alias("rate"))


def copies(docs: DataFrame, source_rates: DataFrame, seed: int = 0) -> DataFrame:
    """All columns in ``row``, with ``rate`` and ``n_copies``."""
    small = materialize(source_rates, "rates")
    most = small.agg(F.max("rate")).first()[0] or 0.0
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # The stored rates have a known size: Catalyst broadcasts them only below its limit.
    joined = rows.join(small, F.col("row.source").eqNullSafe(small["source"]), "left").select("row", "rate")
    chunks = max(1, math.ceil(most / CHUNK))
    mean = F.coalesce("rate", F.lit(0.0)) / float(chunks)
    top = most / chunks
    last = math.ceil(top + TAIL * math.sqrt(top) + 20)
    total = sum((poisson(mean, uniform(F.lit(seed), F.lit(j), identity()), last) for j in range(chunks)), F.lit(0))
    return joined.select("row", F.coalesce("rate", F.lit(0.0)).alias("rate"), total.alias("n_copies"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, size: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixture: ``row`` (all columns), ``copy`` from 1, and ``mix_key``, the place in the global order."""
    counted = copies(docs, rates(docs, weights, power, size), seed).where("n_copies > 0")
    dealt = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    dealt = dealt.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit("mix"), F.lit(seed), identity(), "copy")))
    return dealt.repartition("mix_key", F.xxhash64("row.text")).sortWithinPartitions("mix_key")
