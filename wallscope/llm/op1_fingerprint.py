"""Document fingerprints: bottom-k sketches of word-shingle hashes, with built-in functions only.

A fingerprint is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's
five-word shingles (a shorter text: of all its words). Sketches merge across parts, and
estimate resemblance, containment and the number of distinct shingles. All functions are
Catalyst expressions, so they stay in the JVM next to the scan.

Defined cases: a null or blank text has an empty fingerprint; two empty fingerprints have
likeness 1, an empty and another one 0. ``with_next`` takes rows of one doc_id in the order
of their texts, and a null doc_id as the smallest; other columns are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH, SIZE = 5, 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def sketch(words: Column, k: int = SIZE, width: int = WIDTH) -> Column:
    """Fingerprint of a words array."""
    last = F.greatest(F.size(words) - width + 1, F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, width)))
    hashes = F.when(F.size(words) > 0, shingles).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """Fingerprint of the union of two shingle sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_all(sketches: Column, k: int = SIZE) -> Column:
    """Aggregate: fingerprint of the union over a group, for sketches of the parts of a document."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches)))), 1, k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated intersection over union."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def distinct_count(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") - LEAST) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has as well, from the hashes up to where both sketches reach."""
    reach = F.when(F.size(b) < k, F.lit(MOST)).otherwise(F.element_at(b, -1))
    seen = F.filter(a, lambda h: h <= reach)
    share = F.when(F.size(seen) == 0, 0.0).otherwise(F.size(F.array_intersect(seen, b)) / F.size(seen))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def fingerprints(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """doc_id and fingerprint of every row."""
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    return split.select("doc_id", sketch(F.col("words"), k).alias("fingerprint"))


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """About ``parts`` doc_id values that cut the rows into equal runs; the last is the largest id."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    shares = F.array(*[F.lit((j + 1) / parts) for j in range(parts)]) if parts <= 1000 else None
    shares = shares if shares is not None else F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda j: j / float(parts))
    found = ids.agg(F.percentile_approx("i", shares, 50 * parts).alias("cuts"), F.max("i").alias("most")).first()
    return [] if found["cuts"] is None else sorted({*found["cuts"], found["most"]})


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, and the text of the next document in descending doc_id (after the last: the first).

    Rows are dealt once, by equal runs of doc_id; the first document of each run also goes
    to the run before it, so no row needs another task's rows.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _cuts(rows, parts)
    if not cuts:
        cuts = [0]
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    # Binary search: the number of cuts below doc_id is the number of its run.
    below = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= len(cuts)) & (F.element_at(bounds, F.least(at + s, F.lit(len(cuts)))) < F.coalesce("doc_id", F.lit(LEAST))),
            at + s,
        ).otherwise(at),
    )
    run = rows.withColumn("run", below)
    # A run's largest id is its cut: that row comes next after the least row of the run above it.
    guest = F.element_at(bounds, F.col("run") + 1) == F.col("doc_id")
    above = F.when(F.col("run") + 1 == len(cuts), 0).otherwise(F.col("run") + 1)
    own = F.array(F.struct(F.col("run").alias("to"), F.lit(0).alias("guest")))
    both = F.concat(own, F.array(F.struct(above.alias("to"), F.lit(1).alias("guest"))))
    placed = run.select("doc_id", "text", F.explode(F.when(guest, both).otherwise(own)).alias("at"))
    placed = placed.select("doc_id", "text", F.col("at.to").alias("run"), F.col("at.guest").alias("guest"))
    order = Window.partitionBy("run").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return placed.repartition("run").select(
        "doc_id", "text", "guest", F.lead("text").over(order).alias("next_text")
    ).where("guest = 0").drop("guest")


def compare(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """Fingerprints of every document, its edited text and the next one, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document.
    """
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    rows = rows.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        words(F.col("text")).alias("own_words"),
        words(edited).alias("edited_words"),
        words(F.col("next_text")).alias("next_words"),
    )
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256",
        *(sketch(F.col(f"{n}_words"), k).alias(n) for n in ("own", "edited", "next")),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        containment(F.col("own"), F.col("edited"), k).alias("in_edited"),
        distinct_count(F.col("own"), k).alias("n_shingles"),
    )
