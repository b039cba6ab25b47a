"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct five-word shingles (with fewer words: all of them),
linked with those that have ``100 * |A & B| >= 75 * |A | B|``. Documents with equal sets are
one class from the start. The rest of the way works on classes:

1. Inverted lists of retained hash values. A linked pair shares at least ``SHARED`` of its
   retained values (a probability of missing below 1e-8 at the threshold), so only a
   document's rarest values need a list; boilerplate stays out. Each list has a hub, its
   smallest document, and every other member is paired with the hub only.
2. Pairs are verified on full sets, and links make first groups.
3. Two members of one hub that are still in different groups may be linked without the hub.
   Hubs with such members are cut into tiles of bounded size, which count overlaps of larger
   sketches by matrix products and estimate the union's sketch. A maximum spanning forest of
   the promising pairs is verified first, then all promising pairs across groups that remain.

So lists of any size are never expanded into all their pairs, no shared value is dropped,
and each reported link is verified on full sets. Groups of links are connected components.

Candidates may miss a pair with the stated probability. ``exact=True`` lists all values of a
set and lets no estimate decide, at the cost of longer lists.

Defined cases: a null, empty or blank text has an empty set and links with nothing; rows with
a null doc_id get themselves (null) as component and are kept; rows of one doc_id are one
node, whatever their texts; ``keep_one`` decides per row, so a text stays unless another row
stands for it, and of equal rows one stays; an empty table gives no rows; other columns are
left out. A very long text is taken on its own and needs about 60 times its size while it is
hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscope.llm.arrow import bound_batches, flat_bytes, list_array, pack, ranges, slices
from wallscope.llm.components import components
from wallscope.llm.hot import with_keys
from wallscope.llm.words import shingle_hashes, word_hashes
from wallscope.session import materialize

RETAINED, SHARED = 64, 0.42
SKETCH = 256
TILE = 512
#: Bytes of texts that a task hashes at once; each takes about 60 bytes of temporary arrays.
TEXT_BYTES, PACKED_BYTES = 1 << 20, 1 << 18
#: Standard deviations by which an estimate may miss.
SIGMAS = 6.0


def shingle_sets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (as signed numbers) of texts that lie end to end, and set sizes."""
    hashes, counts = shingle_hashes(*word_hashes(flat, offsets))
    owner, hashes = np.repeat(np.arange(len(counts)), counts), hashes.view(np.int64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)]
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(counts))


def _sets(docs: DataFrame, retained: int | None) -> DataFrame:
    """n, digest and shingles (the ``retained`` smallest of the set, or all) beside the columns that aren't the text.

    The text is in ``text`` or in ``packed``.
    """
    column = "packed" if "packed" in docs.columns else "text"
    beside = [c for c in docs.columns if c != column]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], pa.Array]]:
        for part in slices(batch, column, PACKED_BYTES if column == "packed" else TEXT_BYTES):
            texts = part.column(column)
            if column == "packed":
                unpack = zstandard.ZstdDecompressor().decompress
                texts = pa.array([unpack(t) for t in texts.to_pylist()], pa.large_binary())
            yield [part.column(c) for c in beside], texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for others, texts in parts(batch):
                hashes, sizes = shingle_sets(*flat_bytes(texts))
                starts = np.cumsum(sizes) - sizes
                digests = [hashlib.blake2b(hashes[s : s + n], digest_size=16).digest() for s, n in zip(starts, sizes)]
                kept = sizes if retained is None else np.minimum(sizes, retained)
                lists = list_array(pa.array(hashes[ranges(starts, kept)]), kept)
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), lists],
                    [*beside, "n", "digest", "shingles"],
                )

    kinds = "".join(f"{c} {t}, " for c, t in docs.dtypes if c != column)
    return docs.mapInArrow(run, f"{kinds}n bigint, digest binary, shingles array<bigint>")


def _hubs(classes: DataFrame) -> DataFrame:
    """(x, hub): every class with the hub of each list that it must be in."""
    size = F.size("shingles")
    values = classes.select("id", size.alias("m"), F.explode("shingles").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("c"), F.min("id").alias("hub")).where("c > 1")
    hits = values.join(shared, "v")
    own = Window.partitionBy("id")
    # The rarest m - s + 1 of m values contain one of any s shared ones; values of no other class are the rarest.
    needed = F.col("m") - F.greatest(F.floor(F.col("m") * SHARED), F.lit(1)) + 1 - (F.col("m") - F.count("*").over(own))
    rank = F.row_number().over(own.orderBy("c", "v"))
    listed = hits.select("id", "hub", rank.alias("rank"), needed.alias("needed")).where("rank <= needed AND id <> hub")
    return listed.select(F.col("id").alias("x"), "hub").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    one, two = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    near = pairs.join(one, "a").join(two, "b").where("least(n_a, n_b) * 100 >= greatest(n_a, n_b) * 75")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return near.where(100 * both >= 75 * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct()


def promising(sketches: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs i < j whose estimated resemblance may reach 0.75, and the estimates (exact for whole sets)."""
    rows = len(sketches)
    lengths = np.array([len(s) for s in sketches])
    flat = np.concatenate(sketches)
    owner = np.repeat(np.arange(rows), lengths)
    values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    common = times[place] > 1
    owner_c, column_c = owner[common], column[place[common]]
    both = np.zeros((rows, rows), np.float32)
    for first in range(0, int((times > 1).sum()), 8192):
        here = (column_c >= first) & (column_c < first + 8192)
        present = np.zeros((rows, 8192), np.float32)
        present[owner_c[here], column_c[here] - first] = 1
        both += present @ present.T
    whole = lengths >= sizes
    reach = np.array([np.iinfo(np.int64).max if w else s[-1] for s, w in zip(sketches, whole)])
    # Values of row i up to where row j's sketch reaches.
    seen = np.stack([np.searchsorted(s, reach, side="right") for s in sketches])
    union = seen + seen.T - both
    estimate = both / np.maximum(union, 1)
    exact = whole[:, None] & whole
    room = np.where(exact, 0, SIGMAS * np.sqrt(0.75 * 0.25 / np.maximum(union, 1)))
    ratio = np.minimum(sizes[:, None], sizes) * 100 >= np.maximum(sizes[:, None], sizes) * 75
    hit = np.where(exact, both * 100 >= union * 75, estimate >= 0.75 - room) & ratio & (both > 0)
    i, j = np.nonzero(np.triu(hit, 1))
    return i, j, estimate[i, j]


def forest(groups: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of pairs that form a maximum spanning forest of the groups."""
    parent = {g: g for g in groups.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = np.minimum(groups[i], groups[j]), np.maximum(groups[i], groups[j])
    order = np.lexsort((-weight, b, a))
    best = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])][: len(order)]]
    taken = []
    for k in best[np.argsort(-weight[best], kind="stable")]:
        p, q = root(int(groups[i[k]])), root(int(groups[j[k]]))
        if p != q:
            parent[p] = q
            taken.append(k)
    return np.array(taken, np.int64)


def _tile(spanning: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups = rows["component"].to_numpy()
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        if len(set(groups.tolist())) < 2:
            return none
        i, j, weight = promising([np.asarray(s) for s in rows["sketch"]], rows["n"].to_numpy())
        # In a tile of two blocks, pairs within one block belong to that block's own tile.
        block, cross = rows["block"].to_numpy(), rows["first"].iloc[0] != rows["second"].iloc[0]
        use = (groups[i] != groups[j]) & ((block[i] != block[j]) | (not cross))
        i, j, weight = i[use], j[use], weight[use]
        if spanning and len(i):
            taken = forest(groups, i, j, weight)
            i, j = i[taken], j[taken]
        x = rows["x"].to_numpy()
        return pd.DataFrame({"a": np.minimum(x[i], x[j]), "b": np.maximum(x[i], x[j])})

    return run


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, spanning: bool, exact: bool) -> DataFrame:
    """Promising pairs of members of one hub in different groups, of all or of a spanning forest per tile."""
    known = labels.select(F.col("node").alias("x"), "component")
    placed = members.join(known, "x", "left").select("x", "hub", F.coalesce("component", "x").alias("component"))
    mixed = placed.groupBy("hub").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where("low < high").select("hub", F.ceil(F.col("members") / TILE).cast("int").alias("blocks"))
    open_ = placed.join(mixed, "hub").withColumn("block", F.pmod(F.xxhash64("x"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = open_.select("x", "hub", "component", "block", other)
    tiles = tiles.select("x", "hub", "component", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    sketch = F.col("shingles") if exact else F.slice("shingles", 1, SKETCH)
    sketches = sets.select(F.col("id").alias("x"), "n", sketch.alias("sketch"))
    return tiles.join(sketches, "x").groupBy("hub", "first", "second").applyInPandas(_tile(spanning), "a bigint, b bigint").distinct()


class Groups(NamedTuple):
    #: doc_id, mark (hash of the text), n, id (of the class of its set; null for an empty set), a row per document.
    rows: DataFrame
    #: id, doc_id and mark (the least row that has the set), copies.
    classes: DataFrame
    #: node, component: the groups of linked classes.
    labels: DataFrame


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``id``, a number of their set; and the classes of rows with the same one."""
    for salt in count():
        number = F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.xxhash64(F.lit(salt), "digest"))
        rows = rows.withColumn("id", number)
        check = F.xxhash64("digest", F.lit("check"))
        least = F.min(F.struct("doc_id", "mark", "shingles")).alias("least")
        found = rows.where("id IS NOT NULL").groupBy("id").agg(least, F.count("*").alias("copies"), F.min(check).alias("lo"), F.max(check).alias("hi"))
        found = materialize(found.select("id", "least.*", "copies", "lo", "hi"), "classes")
        # Different sets with one number: all are numbered anew.
        if found.where("lo <> hi").isEmpty():
            return rows, found.drop("lo", "hi")


def _full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """id, n and all shingles of the classes in ``members``."""
    wanted = members.select(F.explode(F.array("x", "hub")).alias("id")).distinct()
    least = classes.join(wanted, "id", "left_semi").select("id", "doc_id", "mark")
    texts = pack(_marked(docs)).join(least, ["doc_id", "mark"]).select("id", "packed")
    sets = materialize(_sets(texts, None).drop("digest"), "sets")
    # Only rows that repeat both doc_id and text give a set twice.
    return sets if sets.count() == least.count() else sets.dropDuplicates(["id"])


def _groups(docs: DataFrame, exact: bool) -> Groups:
    bound_batches(docs.sparkSession)
    rows, classes = _classes(materialize(_sets(_marked(docs), None if exact else RETAINED), "sketches"))
    members = materialize(_hubs(classes), "hubs")
    sets = _full_sets(docs, classes, members)
    edges = materialize(_verified(members.select(F.col("x").alias("a"), F.col("hub").alias("b")), sets), "edges")
    labels = components(edges)
    tried = None
    for spanning in (True, False):
        pairs = _across(members, labels, sets, spanning, exact)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs
        if pairs.isEmpty():
            break
        more = materialize(_verified(pairs, sets), "edges")
        if not more.isEmpty():
            edges = edges.union(more)
            labels = components(edges)
    return Groups(rows.select("doc_id", "mark", "n", "id"), classes.drop("shingles"), labels)


def _with_least(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes with ``least`` (doc_id, mark), the least row of all classes with their label."""
    own = F.struct("doc_id", "mark")
    labels = labels.select(F.col("node").alias("id"), "component")
    linked = materialize(classes.join(labels, "id"), "linked")
    lowest = materialize(linked.groupBy("component").agg(F.min(own).alias("least"), F.count("*").alias("size")), "lowest")
    named = with_keys(linked, lowest, ["component"], "size", linked.count())
    alone = classes.join(labels, "id", "left_anti").withColumn("least", own)
    return named.select(*alone.columns).unionByName(alone)


def _joined(groups: Groups, several: DataFrame) -> DataFrame:
    """Labels of classes (node, component) that also join the groups of each doc_id in ``several``."""
    labels = groups.labels
    if several.isEmpty():
        return labels
    own = groups.rows.where("id IS NOT NULL").join(several, "doc_id", "left_semi").select("doc_id", "id").distinct()
    named = labels.select(F.col("node").alias("id"), "component")
    own = materialize(own.join(named, "id", "left").select("doc_id", "id", F.coalesce("component", "id").alias("group")), "repeated")
    first = own.groupBy("doc_id").agg(F.min("group").alias("a"))
    upper = components(own.join(first, "doc_id").select("a", F.col("group").alias("b")))
    every = labels.unionByName(own.select(F.col("id").alias("node"), F.col("group").alias("component"))).distinct()
    upper = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return materialize(every.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    groups = _groups(docs, exact)
    rows = groups.rows
    again = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("sets")
    )
    again = materialize(again.where("rows > 1"), "again")
    labels = _joined(groups, again.where("lo <> hi").select("doc_id"))
    named = _with_least(groups.classes, labels).select("id", "copies", F.col("least.doc_id").alias("component_id"))
    named = materialize(named, "named")
    sound = rows.where("id IS NOT NULL")
    linked = with_keys(sound.select("doc_id", "n", "id"), named, ["id"], "copies", sound.count())
    alone = rows.where("id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    mixed = again.where("sets > 0 AND sets < rows").select("doc_id", F.col("lo").alias("id"))
    if not mixed.isEmpty():
        # An empty text of a doc_id that has other texts as well.
        mixed = mixed.join(named, "id").select("doc_id", F.col("component_id").alias("other"))
        alone = alone.join(mixed, "doc_id", "left").select("doc_id", "n", F.coalesce("other", "component_id").alias("component_id"))
    found = linked.select("doc_id", "n", "component_id").union(alone)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, exact: bool = False) -> DataFrame:
    """The documents, with all their columns, without those that another one of their group stands for."""
    groups = _groups(docs, exact)
    named = materialize(_with_least(groups.classes, groups.labels).select("id", "copies", "least"), "named")
    sound = groups.rows.where("id IS NOT NULL")
    placed = with_keys(sound.select("doc_id", "mark", "id"), named, ["id"], "copies", sound.count())
    dropped = placed.where(F.struct("doc_id", "mark") != F.col("least"))
    dropped = materialize(dropped.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "dropped")
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_mark")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *key)
    rows = rows.join(dropped, ["_id", "_mark"], "left_anti")
    equal = sound.groupBy("doc_id", "mark").count().where("count > 1")
    equal = materialize(equal.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "equal")
    if not equal.isEmpty():
        once = rows.join(equal, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"])
        rows = rows.join(equal, ["_id", "_mark"], "left_anti").unionByName(once)
    return rows.select("row.*")
