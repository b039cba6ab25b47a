"""Removal of long repeated byte strings with suffix arrays built by grouping.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is removed.

1. Anchors: a string of ``LENGTH`` bytes holds a whole window of ``WINDOW`` positions from its
   start on; its anchor is the first of them whose hash of ``GRAM`` bytes is the smallest. So
   equal strings have their anchor at the same distance from their start, 0 to ``WINDOW - 1``
   bytes. An anchor's core is what all strings around it share; its context is all they cover.
   In a passage that repeats itself at a short distance, such as one phrase over and over,
   there is an anchor in every period. Its strings repeat each other, so it is cut as it
   stands, and only the anchors of its first period stand for it in the steps that follow.
2. Contexts are grouped by core, with counts only, so a passage that a third of all documents
   repeat is one row per task. A core seen once holds no repeat. A context seen twice or more
   is covered as a whole. What remains are different contexts of one core.
3. Those of up to ``GROUP`` contexts a core are put into tasks of bounded size. Their right
   sides and reversed left sides are suffix-sorted (``grouping.suffix_array``); common
   prefixes of neighbours give classes for every distance, and a string is repeated if its
   left and right classes occur together elsewhere.
4. Cores with more contexts are refined: the range of distances is split in four (at last
   five), which makes the core longer and the groups smaller, until a core is the string itself.

Strings are judged on the input. No step gathers an unbounded group, and none drops one.

Defined cases: a null text is an empty one; texts shorter than ``LENGTH`` bytes stay; rows
that repeat a doc_id count as documents of their own, so equal ones repeat each other; a null
doc_id is allowed; an empty table gives no rows; other columns are carried along. Kept texts
lose the rest of a character that a cut leaves incomplete. A very long text is taken on its
own and needs about 60 times its size while its anchors are found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.llm.arrow import bound_batches, flat_bytes, pack, slices
from wallscope.llm.grouping import suffix_array
from wallscope.llm.hot import with_keys
from wallscope.llm.words import BYTE, mix
from wallscope.session import materialize

LENGTH, GRAM, WINDOW = 400, 24, 320
CORE = LENGTH - WINDOW + 1
#: Most contexts of a core that one suffix array takes together, and about how many a task takes.
GROUP, TASK = 2000, 4000
#: Bytes that one symbol of the suffix arrays stands for.
SYMBOL = 80
#: Compressed bytes of texts that a task cuts at once.
PACKED_BYTES = 1 << 18
#: Widths of the ranges of distances, each level within the one before.
LEVELS = (320, 80, 20, 5, 1)

PLACE = "id bigint, mark bigint, at int, lo int, hi int"
SPANS = "id bigint, mark bigint, start int, stop int"


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie end to end: positions, starts of their first and last strings, hashes.

    Every string of a text belongs to one anchor.
    """
    if len(flat) < LENGTH:
        return (np.empty(0, np.int64),) * 4
    with np.errstate(over="ignore"):
        h = BYTE[flat]
        for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93)):
            h8 = h
            h = h[:-step] * np.uint64(odd) + h[step:]
        h = h[:-8] * np.uint64(0xA0761D6478BD642F) + h8[16 : 16 + len(h) - 8]
        # The hash, and below it the position, so that the first of equal hashes is the smallest.
        low = mix(h) >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32, 64, 128):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: -(WINDOW - 256)], low[WINDOW - 256 :])
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    starts = np.flatnonzero(np.arange(len(low)) + LENGTH <= end)
    low = low[starts]
    # Windows that begin later have later anchors, so an anchor's strings begin in one range.
    heads = np.flatnonzero(np.r_[True, low[1:] != low[:-1]][: len(low)])
    tails = np.r_[heads[1:] - 1, len(low) - 1][: len(heads)]
    return (low[heads] & np.uint64(0xFFFFFFFF)).astype(np.int64), starts[heads], starts[tails], (low[heads] >> np.uint64(32)).astype(np.int64)


def periodic(raw: bytes, found: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Passages in which strings repeat each other at one distance: first and last anchor (by number), that distance, end.

    A passage begins at its first anchor; each of its strings but those of the first distance equals an earlier one.
    """
    step = np.diff(found)
    step[(hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])] = 0
    heads = np.flatnonzero(np.r_[True, step[1:] != step[:-1]][: len(step)])
    out = []
    for first, last in zip(heads.tolist(), np.r_[heads[1:], len(step)].tolist()):
        distance, begin, end = int(step[first]), int(found[first]), int(found[last]) + GRAM
        if distance and end - LENGTH >= begin + distance and raw[begin : end - distance] == raw[begin + distance : end]:
            out.append((first, last, distance, end))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """id, mark (with id the key of a text), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")
    )


def _anchored(docs: DataFrame) -> DataFrame:
    """A row per anchor: its place, the distances lo to hi of its strings, core and context as digests.

    Rows without a core are places whose strings repeat each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets = flat_bytes(part.column("text"))
                found, begin, last, hashes = anchors(flat, offsets)
                row = np.searchsorted(offsets, found, side="right") - 1
                raw = flat.tobytes()
                use, sure = np.ones(len(found), bool), []
                for one, other, distance, end in periodic(raw, found, hashes, row):
                    own = slice(one, other + 1)
                    use[own] &= (begin[own] < found[one] + distance) | (last[own] > end - LENGTH)
                    sure.append((row[one], found[one] - offsets[row[one]], found[one] + LENGTH - end))
                found, row, begin, last = found[use], row[use], begin[use], last[use]
                at, lo, hi = found - offsets[row], found - last, found - begin
                digest = lambda a, b, size, salt=b"": hashlib.blake2b(raw[a:b], digest_size=size, salt=salt).digest()
                cores = [digest(p, p + CORE, 8) for p in found.tolist()]
                fulls = [
                    digest(p - h, p - o + LENGTH, 16, b"%d-%d" % (o, h))
                    for p, o, h in zip(found.tolist(), lo.tolist(), hi.tolist())
                ]
                core = pa.array(np.frombuffer(b"".join(cores), np.int64))
                sure_row, sure_at, sure_lo = np.array(sure, np.int64).reshape(-1, 3).T
                none = pa.nulls(len(sure), pa.int64()), pa.nulls(len(sure), pa.binary())
                keys = [part.column(c).to_numpy()[np.r_[row, sure_row]] for c in ("id", "mark")]
                places = (np.r_[at, sure_at], np.r_[lo, sure_lo], np.r_[hi, np.zeros(len(sure), np.int64)])
                digests = (pa.concat_arrays(pair) for pair in zip((core, pa.array(fulls, pa.binary())), none))
                arrays = [*map(pa.array, keys), *(pa.array(x.astype(np.int32)) for x in places), *digests]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "mark", "at", "lo", "hi", "core", "full"])

    return _keyed(docs).mapInArrow(run, f"{PLACE}, core bigint, full binary")


def _span(docs_rows: DataFrame) -> DataFrame:
    """What the contexts of rows with a place cover."""
    return docs_rows.select("id", "mark", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + LENGTH).alias("stop"))


def _contexts(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """``open_`` with the bytes around each anchor: ``context``, which begins ``hi`` bytes before it.

    A text that occurs in several rows of one id gives its contexts as often.
    """
    listed = open_.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "lo", "hi", "core", "full", "n", "m")).alias("places"))
    texts = pack(_keyed(docs)).join(listed, ["id", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["at", "lo", "hi", "core", "full", "n", "m"]
        kinds = [pa.int32()] * 3 + [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            for id_, mark, packed, places in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "packed", "places"))):
                text = zstandard.ZstdDecompressor().decompress(packed)
                for k in range(0, len(places), 2000):
                    some = places[k : k + 2000]
                    cut = [text[p["at"] - p["hi"] : p["at"] - p["lo"] + LENGTH] for p in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([id_] * len(some)), pa.array([mark] * len(some)), *(pa.array([p[c] for p in some], t) for c, t in zip(names, kinds)), pa.array(cut, pa.binary())],
                        ["id", "mark", *names, "context"],
                    )

    return texts.mapInArrow(run, f"{PLACE}, core bigint, full binary, n bigint, m bigint, context binary")


def classes(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in suffix-array order, and the common prefix of each with the one before (0 for the first)."""
    count, width = parts.shape
    blocks = np.ascontiguousarray(parts).reshape(-1, SYMBOL).view(f"V{SYMBOL}").ravel()
    ranks = np.unique(blocks, return_inverse=True)[1].reshape(count, -1) + 1
    text = np.c_[ranks, np.zeros(count, np.int64)].ravel()
    order = suffix_array(text)
    stride = width // SYMBOL + 1
    order = order[order % stride == 0] // stride
    differs = parts[order[1:]] != parts[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), width)
    return order, np.r_[0, common]


def repeated(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every context the least and largest distance at which another one has its string (-1: none)."""
    count = len(contexts)
    right, left = np.zeros((count, LENGTH), np.uint8), np.zeros((count, WINDOW), np.uint8)
    for k, (c, h) in enumerate(zip(contexts, hi.tolist())):
        raw = np.frombuffer(c, np.uint8)
        right[k, : len(raw) - h] = raw[h:]
        left[k, :h] = raw[:h][::-1]
    (by_right, same_right), (by_left, same_left) = classes(right), classes(left)
    out = np.full((count, 2), -1)
    number_r, number_l = np.empty(count, np.int64), np.empty(count, np.int64)
    for distance in range(int(lo.min()), int(hi.max()) + 1):
        number_l[by_left] = np.cumsum(same_left < distance)
        number_r[by_right] = np.cumsum(same_right < LENGTH - distance)
        # A context that is alone on either side has no partner at this distance.
        shared = (np.bincount(number_l)[number_l] > 1) & (np.bincount(number_r)[number_r] > 1)
        valid = np.flatnonzero(shared & (lo <= distance) & (distance <= hi))
        if not len(valid):
            continue
        key = number_l[valid] * (count + 2) + number_r[valid]
        _, place = np.unique(key, return_inverse=True)
        hit = valid[np.bincount(place, weight[valid])[place] >= 2]
        out[hit, 1] = distance
        out[hit, 0] = np.where(out[hit, 0] < 0, distance, out[hit, 0])
    return out


def _sorted_tile(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates(["core", "full"])
    lo, hi, n = (rows[c].to_numpy() for c in ("lo", "hi", "n"))
    begin = rows["begin"].to_numpy()
    found = repeated([c[b:] for c, b in zip(rows["context"], (begin - hi).tolist())], lo, hi, n)
    hit = (found[:, 0] >= 0) & (n == 1)
    at = rows["at"].to_numpy()[hit]
    # All strings around one anchor overlap, so what they cover is one span.
    return pd.DataFrame({
        "id": rows["id"].to_numpy()[hit], "mark": rows["mark"].to_numpy()[hit],
        "start": (at - found[hit, 1]).astype(np.int32), "stop": (at - found[hit, 0] + LENGTH).astype(np.int32),
    })


def _sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("core").agg(F.count("*").alias("m")).where("m > 1")


def _sort(small: DataFrame) -> DataFrame:
    """Spans of contexts whose cores have few of them."""
    tasks = max(1, math.ceil(small.count() / TASK))
    columns = ["id", "mark", "at", "lo", "hi", "core", "full", "n", "begin", "context"]
    dealt = small.select(*columns).withColumn("task", F.pmod(F.xxhash64("core"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(_sorted_tile, SPANS)


def _split(large: DataFrame, level: int) -> DataFrame:
    """Contexts cut to the ranges of the next level, with the longer cores these have."""
    width, before = LEVELS[level], LEVELS[level - 1]
    first = F.explode(F.sequence(F.col("from"), F.col("from") + before - width, F.lit(width)))
    cut = large.withColumn("from_", first).drop("from").withColumnRenamed("from_", "from")
    cut = cut.withColumn("lo", F.greatest("lo", "from")).withColumn("hi", F.least("hi", F.col("from") + width - 1)).where("lo <= hi")
    inner = F.expr(f"substring(context, begin - from + 1, {LENGTH - width + 1})")
    outer = F.expr(f"substring(context, begin - hi + 1, hi - lo + {LENGTH})")
    full = F.unhex(F.md5(F.concat(outer, F.encode(F.concat_ws("-", F.lit(""), "lo", "hi"), "UTF-8"))))
    return cut.withColumn("core", F.xxhash64("core", "from", inner)).withColumn("full", full)


def repeats(docs: DataFrame) -> DataFrame:
    """Spans (id, mark, start, stop) of repeated bytes; they may overlap and occur more than once."""
    bound_batches(docs.sparkSession)
    found = materialize(_anchored(docs), "anchors")
    every, sure = found.where("core IS NOT NULL"), found.where("core IS NULL")
    cores = materialize(every.groupBy("core").agg(F.count("*").alias("c")).where("c > 1"), "cores")
    candidates = materialize(with_keys(every, cores, ["core"], "c", every.count()), "candidates")
    place = F.min(F.struct("id", "mark", "at", "lo", "hi")).alias("place")
    groups = candidates.groupBy("core", "full").agg(F.count("*").alias("n"), place, F.max("c").alias("c"))
    groups = materialize(groups, "groups")
    whole = groups.where("n > 1").select("core", "full", "n")
    spans = [_span(sure), materialize(_span(with_keys(candidates, whole, ["core", "full"], "n", candidates.count())), "spans")]
    # How many contexts its core has, or may have, goes with each row, so contexts are dealt to tasks
    # in one shuffle. A core of few rows needs no count of its contexts: if one has all rows, n is c.
    few = groups.where((F.col("c") <= GROUP) & (F.col("n") < F.col("c"))).withColumn("m", F.col("c"))
    many = groups.where(F.col("c") > GROUP)
    sizes = materialize(_sizes(many), "sizes")
    open_ = few.unionByName(with_keys(many, sizes, ["core"], "m", groups.count()))
    open_ = open_.select("place.*", "core", "full", "n", "m")
    rows = _contexts(docs, open_).withColumn("from", F.lit(0)).withColumn("begin", F.col("hi"))
    for level in range(1, len(LEVELS) + 1):
        rows = materialize(rows, "contexts")
        spans.append(materialize(_sort(rows.where(F.col("m") <= GROUP)), "spans"))
        big = rows.where(F.col("m") > GROUP)
        if level == len(LEVELS) or big.isEmpty():
            break
        cut = materialize(_split(big.dropDuplicates(["core", "full"]), level), "ranges")
        found = cut.groupBy("core", "full").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
        found = materialize(found, "found")
        many = found.where("total > 1").select("core", "full", "k")
        rows_cut = cut.count()
        spans.append(materialize(_span(with_keys(cut.where("n = 1"), many, ["core", "full"], "k", rows_cut)), "spans"))
        # One context of each kind goes on; those seen more than once only as partners.
        kinds = materialize(with_keys(found, materialize(_sizes(found), "sizes"), ["core"], "m", found.count()), "kinds")
        rows = with_keys(cut.drop("n", "m"), kinds, ["core", "full"], "k", rows_cut).drop("k")
        rows = rows.withColumnRenamed("total", "n").dropDuplicates(["core", "full"])
    return reduce(DataFrame.union, spans)


def trim(raw: bytes) -> str:
    """Text of kept bytes, without the rest of cut characters."""
    return raw.decode("utf-8", "ignore")


def cut(docs: DataFrame) -> DataFrame:
    """Per document ``row`` (all its columns), n_bytes, n_removed, n_spans and ``kept`` (bytes)."""
    listed = repeats(docs).distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    keyed = docs.select(
        others.alias("row"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("mark"),
        docs["text"].alias("text"),
        docs["text"].isNull().alias("absent"),
    )
    joined = pack(keyed).join(listed, ["id", "mark"], "left").select("row", "absent", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "packed", PACKED_BYTES)):
            columns = [[], [], [], []]
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                text = zstandard.ZstdDecompressor().decompress(packed)
                runs: list[list[int]] = []
                for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                edges = [0, *(e for r in runs for e in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(columns, (len(text), len(text) - len(kept), len(runs), kept)):
                    column.append(value)
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("absent"), *arrays], ["row", "absent", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, absent boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def remove(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without repeated strings; texts that nothing is cut from stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "kept")):
            texts = [None if a else trim(k) for a, k in zip(batch.column("absent").to_pylist(), batch.column("kept").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    found = cut(docs).select("row", "absent", "kept")
    kind = found.schema["row"].dataType.simpleString()
    texts = found.mapInArrow(run, f"row {kind}, text string")
    return texts.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
