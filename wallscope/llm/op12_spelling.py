"""Grouping of spelling variants by k-d trees over letter counts.

Words that differ by one edit have letter counts that differ by one letter more, one less, or
both: an L1 distance of at most two, and of exactly one between words of different length.
So for each pair of lengths (equal, one longer, one shorter) the words near a word lie in a
small range of letter-count space. A k-d tree cuts that space into boxes; boxes out of range
are pruned, and what is left is compared letter by letter.

1. Words are counted per task in numpy, then by Spark.
2. For lengths with many words a top tree is fitted on a bounded sample. Its leaves are
   cells: a word is a member of one, and asks in all cells of the three lengths that its
   range meets. Members and questions of a cell meet in tiles of bounded size.
3. A tile builds a k-d tree of its members and sends all its questions down together.

Every near pair is found once from each side, so counts just add up, and no table of pairs
is made. The most frequent near word gives the form; roots follow forms by pointer doubling.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty one where
runs are hashed; repeated rows count as documents of their own; a run may be as long as a
text; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.llm.arrow import bound_batches, flat_bytes, slices
from wallscope.llm.tiles import dealt, tiled
from wallscope.llm.words import BYTE, STEP
from wallscope.session import materialize

LENGTH, COUNT, FACTOR, ERASE = 6, 5, 5, 199
#: Bytes of texts that a task takes apart at once, and distinct words that it holds.
TEXT_BYTES, HELD = 1 << 20, 400_000
#: Runs of more bytes are counted one by one.
LONG = 64
#: Words of the sample for top trees; words per cell, and members and questions that meet in a tile.
SAMPLE, CELL, BLOCK, ASKED = 100_000, 8192, 16_384, 65_536
#: Words of a leaf of a tile's tree.
LEAF = 8
LETTERS = 26 + 64
RUN = re.compile("[A-Za-zÀ-ÿ]+")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII = np.zeros(256, bool)
ASCII[65:91] = ASCII[97:123] = True
FOLD = {c: c + 32 for c in range(65, 91)}
#: Second random value per byte, so that words are told apart by 128 bits.
OTHER = np.random.Generator(np.random.PCG64(20240612)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def erased(word: str, crc: int) -> str:
    """The lower-cased run, without a letter if its checksum says so."""
    if crc % ERASE:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


def count_words(flat: np.ndarray, offsets: np.ndarray, prefixes: list[bytes], held: Counter) -> None:
    """Add the words of ``LENGTH`` letters or more of UTF-8 texts that lie end to end to ``held`` (as bytes)."""
    flat = LOWER[flat]
    lead = flat == 0xC3
    second = np.r_[False, lead[:-1]][: len(flat)]
    inside = ASCII[flat] | lead | second
    inside = np.r_[False, inside, False]
    breaks = np.zeros(len(inside), bool)
    breaks[offsets[:-1] + 1] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | breaks[1:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | breaks[2:])) + 1
    points = np.r_[0, np.cumsum(~second)]
    sizes = points[stops] - points[starts]
    use = sizes >= LENGTH
    starts, stops, sizes = starts[use], stops[use], sizes[use]
    if not len(starts):
        return
    row = np.searchsorted(offsets, starts, side="right") - 1
    raw, spans = flat.tobytes(), stops - starts
    for k in np.flatnonzero(spans > LONG).tolist():
        word = raw[starts[k] : stops[k]]
        held[erased(word.decode(), zlib.crc32(word, zlib.crc32(prefixes[row[k]]))).encode()] += 1
    short = spans <= LONG
    starts, spans, row = starts[short], spans[short], row[short]
    state = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[row] ^ np.uint32(0xFFFFFFFF)
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    # By length, so that the words that go on are a slice.
    order = np.argsort(-spans, kind="stable")
    starts, spans, state = starts[order], spans[order], state[order]
    going = np.searchsorted(-spans, -np.arange(1, LONG + 1), side="right")
    with np.errstate(over="ignore"):
        for k, n in enumerate(going.tolist()):
            if not n:
                break
            byte = flat[starts[:n] + k]
            state[:n] = CRC[(state[:n] ^ byte) & 255] ^ (state[:n] >> np.uint32(8))
            one[:n] = one[:n] * STEP + BYTE[byte]
            two[:n] = (two[:n] ^ OTHER[byte]) * STEP
    state ^= np.uint32(0xFFFFFFFF)
    cut = state % ERASE == 0
    for k in np.flatnonzero(cut).tolist():
        held[erased(raw[starts[k] : starts[k] + spans[k]].decode(), int(state[k])).encode()] += 1
    starts, spans, one, two = starts[~cut], spans[~cut], one[~cut], two[~cut]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)])
    times = np.diff(np.r_[first, len(one)])
    for at, span, n in zip(starts[order[first]].tolist(), spans[order[first]].tolist(), times.tolist()):
        held[raw[at : at + span]] += n


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: the words of ``LENGTH`` letters or more that occur at least ``COUNT`` times."""
    bound_batches(docs.sparkSession)

    def flush(held: Counter) -> pa.RecordBatch:
        words = [w for w in held if len(w) >= LENGTH]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"]
        )
        held.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                prefixes = [f"{'' if i is None else i}:".encode() for i in part.column("doc_id").to_pylist()]
                count_words(*flat_bytes(part.column("text")), prefixes, held)
                if len(held) > HELD:
                    yield flush(held)
        yield flush(held)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    found = found.groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= COUNT) & (F.char_length("word") >= LENGTH))


def letters(words: list[str]) -> np.ndarray:
    """Letters of words of one length as small numbers (words x length)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return np.where(codes < 128, codes - 97, codes - (0xC0 - 26)).astype(np.uint8)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each word has each letter (words x ``LETTERS``)."""
    rows = len(codes)
    place = (np.arange(rows)[:, None] * LETTERS + codes).ravel()
    return np.bincount(place, minlength=rows * LETTERS).reshape(rows, LETTERS).astype(np.int32)


class Tree(NamedTuple):
    """A k-d tree: node k has the words with ``counts[dim[k]] <= cut[k]`` at ``left[k]``, others at ``right[k]``.

    Leaves have ``dim`` -1 and their number in ``left``.
    """

    dim: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]

    def assign(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, work = np.empty(len(counts), np.int64), [(0, np.arange(len(counts)))]
        while work:
            node, rows = work.pop()
            if self.dim[node] < 0:
                out[rows] = self.left[node]
                continue
            low = counts[rows, self.dim[node]] <= self.cut[node]
            work += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out

    def reached(self, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and the rows whose range meets their box: up to ``more`` letters more and ``less`` fewer."""
        far = 1 << 30
        nothing = np.zeros(len(counts), np.int32)
        work = [(0, np.arange(len(counts)), nothing, nothing, {})]
        while work:
            node, rows, up, down, box = work.pop()
            if not len(rows):
                continue
            dim = self.dim[node]
            if dim < 0:
                yield self.left[node], rows
                continue
            low, high = box.get(dim, (-far, far))
            own, cut = counts[rows, dim], self.cut[node]
            # Only what this cut adds to the distance from the box.
            beyond = down + np.maximum(own - cut, 0) - np.maximum(own - high, 0)
            near = beyond <= less
            work.append((self.left[node], rows[near], up[near], beyond[near], {**box, dim: (low, cut)}))
            beyond = up + np.maximum(cut + 1 - own, 0) - np.maximum(low - own, 0)
            near = beyond <= more
            work.append((self.right[node], rows[near], beyond[near], down[near], {**box, dim: (cut + 1, high)}))


def grow(counts: np.ndarray, most: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree whose leaves hold at most ``most`` rows, but for rows of equal counts; and the rows of each leaf."""
    tree, leaves, work = Tree([-1], [0], [0], [0]), [], [(0, np.arange(len(counts)))]
    while work:
        node, rows = work.pop()
        own = counts[rows]
        spread = own.var(0) if len(rows) > most else np.zeros(1)
        if not spread.any():
            tree.left[node] = len(leaves)
            leaves.append(rows)
            continue
        dim = int(spread.argmax())
        values = np.sort(own[:, dim])
        cut = int(values[(len(values) - 1) // 2])
        if cut == values[-1]:
            cut = int(values[np.searchsorted(values, cut) - 1])
        elif abs(np.searchsorted(values, cut) - len(values) / 2) < abs(np.searchsorted(values, cut, "right") - len(values) / 2) and cut > values[0]:
            cut = int(values[np.searchsorted(values, cut) - 1])
        low = own[:, dim] <= cut
        tree.dim[node], tree.cut[node] = dim, cut
        tree.left[node], tree.right[node] = len(tree.dim), len(tree.dim) + 1
        for column in tree:
            column += [-1 if column is tree.dim else 0] * 2
        work += [(tree.left[node], rows[low]), (tree.right[node], rows[~low])]
    return tree, leaves


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b (letters) differ by exactly one inserted, deleted or replaced letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
    return head + tail >= a.shape[1]


#: Candidates verified at once.
PAIRS = 1 << 18


def near_pairs(asked: list[str], members: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all near words (one length each; differing by one at most): in ``asked``, in ``members``."""
    a, b = letters(asked), letters(members)
    counts_a, counts_b = letter_counts(a), letter_counts(b)
    more, less = int(b.shape[1] >= a.shape[1]), int(b.shape[1] <= a.shape[1])
    tree, leaves = grow(counts_b, LEAF)
    packed_a, packed_b = counts_a.astype(np.int16), counts_b.astype(np.int16)
    found, held, waiting = [(np.empty(0, np.int64),) * 2], [], 0

    def verify() -> None:
        i, j = (np.concatenate(p) for p in zip(*held))
        near = one_edit(a[i], b[j])
        found.append((i[near], j[near]))
        held.clear()

    for leaf, rows in tree.reached(counts_a, more, less):
        own = leaves[leaf]
        for k in range(0, len(own), LEAF):
            some = own[k : k + LEAF]
            for start in range(0, len(rows), 4096):
                part = rows[start : start + 4096]
                gap = np.abs(packed_a[part][:, None, :] - packed_b[some]).sum(2, dtype=np.int32)
                i, j = np.nonzero(gap <= more + less)
                if len(i):
                    held.append((part[i], some[j]))
                    waiting += len(i)
                if waiting > PAIRS:
                    verify()
                    waiting = 0
    if held:
        verify()
    i, j = (np.concatenate(p) for p in zip(*found))
    return i, j


def _tile(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each word with near ones among the members: their number and the most frequent one."""
    none = pd.DataFrame({"word": [], "n_near": [], "near_n": [], "near": []})
    if not len(members) or not len(asked):
        return none
    members = members.sort_values("word", ignore_index=True)
    words, n = members["word"].tolist(), members["n"].to_numpy()
    parts = []
    for _, own in asked.groupby(asked["word"].str.len()):
        i, j = near_pairs(own["word"].tolist(), words)
        # Largest n first, then smallest word.
        order = np.lexsort((j, -n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
        parts.append((own["word"].to_numpy()[i[first]], np.diff(np.r_[first, len(i)]), n[j[first]], members["word"].to_numpy()[j[first]]))
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pd.DataFrame(dict(zip(("word", "n_near", "near_n", "near"), columns)))


def _top_trees(words: DataFrame) -> dict[int, Tree]:
    """Top trees of the lengths with many words, fitted on a bounded sample."""
    sizes = words.groupBy(F.char_length("word").alias("length")).count().where(F.col("count") > CELL)
    # There are fewer such lengths than words / CELL; those that a bounded sample can't show have one cell.
    total = words.count()
    draw = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    some = words if total <= SAMPLE else words.where(draw < int((1 << 30) * SAMPLE / total))
    some = some.join(sizes, F.char_length("word") == F.col("length"), "left_semi").limit(2 * SAMPLE).toPandas()["word"]
    per_cell = max(1, int(CELL * min(1, SAMPLE / max(total, 1))))
    return {int(n): grow(letter_counts(letters(own.tolist())), per_cell)[0] for n, own in some.groupby(some.str.len())}


def _cells(words: DataFrame, trees: dict[int, Tree], asking: bool) -> DataFrame:
    """word, n and cell: the word's own cell, or all cells where near words may be."""

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        words_ = pd.Series(batch.column("word").to_pylist(), dtype=object)
        for length, own in words_.groupby(words_.str.len()):
            yield int(length), own.index.to_numpy(), letter_counts(letters(own.tolist()))

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for length, at, counts in by_length(batch):
            for target in (length - 1, length, length + 1) if asking else (length,):
                if target not in trees:
                    yield target, at, np.zeros(len(at), np.int64)
                elif not asking:
                    yield target, at, trees[target].assign(counts)
                else:
                    for leaf, rows in trees[target].reached(counts, int(target >= length), int(target <= length)):
                        yield target, at[rows], np.full(len(rows), leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, at, leaf in placed(batch):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((target << 32) + leaf)], ["word", "n", "cell"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, cell bigint")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and ``best`` (near_n, near), the most frequent near word, of words that have one."""
    trees = _top_trees(words)
    own, asked = (materialize(_cells(words, trees, asking), "cells") for asking in (False, True))
    spread = F.col("word").alias("spread")
    left, right = tiled(own.select("*", spread), asked.drop("n").select("*", spread), "cell", BLOCK, ASKED)
    tasks = -(-own.count() // 2048)
    keys = ["cell", "l", "r"]
    found = dealt(left, "cell", tasks).groupBy(*keys).cogroup(dealt(right, "cell", tasks).groupBy(*keys))
    found = found.applyInPandas(lambda a, b: _tile(a, b), "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for (word, form): the end of each chain. Forms lead to ever more frequent words, so there is one."""
    jumps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "roots")
        jumps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return jumps


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = materialize(vocabulary(docs), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("best").isNotNull() & (-F.col("best.less") >= FACTOR * F.col("n"))
    found = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    found = materialize(found, "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
