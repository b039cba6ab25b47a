"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's words (after the tokenizer's pre-split) lie end to end in one symbol array. In
each round every pair of neighbours is looked up by binary search in the sorted pair keys,
every word merges all occurrences of its lowest-ranked pair, and words without a mergeable
pair leave. Both directions are narrow: no shuffle, memory bounded by a slice of text.

Defined cases: a null text is encoded as an empty one; ids of a null list decode to ''; the
strings of added tokens are encoded as these tokens; other columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wallscope.llm.arrow import binary, bound_batches, list_array, ranges, slices

# Fixed value: the pre-split of byte-level BPE; white space as the Unicode property has it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Texts without characters from here on take the standard library's pattern engine, which is faster.
NARROW = 0x250


def narrow_split() -> str:
    """``SPLIT`` with its properties written out for the characters below ``NARROW``."""
    pattern = SPLIT
    for name in (r"\p{L}", r"\p{N}"):
        members = "".join(re.escape(chr(c)) for c in range(NARROW) if regex.match(name, chr(c)))
        pattern = pattern.replace(f"{name}+", f"[{members}]+").replace(name, members)
    return pattern


#: Words whose ids a worker remembers before it starts afresh.
CACHED_WORDS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: character to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """Vocabulary and merges of one tokenizer file as arrays, and the ids of words seen lately."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.split, self.narrow = regex.compile(SPLIT), re.compile(narrow_split())
        self.wide = re.compile(f"[^\\x00-{chr(NARROW - 1)}]")
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.byte_lengths, self.byte_starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64)
        for token, i in self.added.items():
            self.remember([token], np.array([i], np.int32), np.array([1]))

    def remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def words(self, text: str) -> list[str]:
        find = (self.split if self.wide.search(text) else self.narrow).findall
        if self.cuts is None or not any(token in text for token in self.added):
            return find(text)
        parts = self.cuts.split(text)
        return [w for p in parts for w in ([p] if p in self.added else find(p))]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each."""
        raw = [w.encode() for w in words]
        symbols = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), [len(b) for b in raw])
        done_symbols, done_owner = [], []
        while len(symbols) > 1:
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.ranks[at], len(self.keys))
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, len(self.keys)], heads)
            sizes = np.diff(np.r_[heads, len(symbols)])
            active = np.repeat(best < len(self.keys), sizes)
            chosen = np.r_[rank, len(self.keys)] == np.repeat(best, sizes)
            chosen &= active
            # In a run of overlapping equal pairs (aaa) every second one merges, from the left.
            run = np.flatnonzero(chosen & ~np.r_[False, chosen[:-1]])
            here = np.flatnonzero(chosen)
            origin = run[np.searchsorted(run, here, side="right") - 1]
            here = here[(here - origin) % 2 == 0]
            symbols[here] = self.merged[at[here]]
            keep = np.ones(len(symbols), bool)
            keep[here + 1] = False
            done_symbols.append(symbols[~active])
            done_owner.append(owner[~active])
            keep &= active
            symbols, owner = symbols[keep], owner[keep]
        done_symbols.append(symbols)
        done_owner.append(owner)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(raw))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        split = [self.words(t) for t in texts]
        known = self.known
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        if new:
            self.remember(new, *self.merge(new))
        rows = np.fromiter((known[w] for words in split for w in words), np.int64)
        ids = self.ids[ranges(self.starts[rows], self.lengths[rows])]
        ends = np.cumsum(np.r_[0, self.lengths[rows]])
        bounds = np.cumsum([0, *map(len, split)])
        return ids, np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of id sequences that lie end to end; broken UTF-8 becomes U+FFFD."""
        raw = self.bytes[ranges(self.byte_starts[ids], self.byte_lengths[ids])].tobytes()
        ends = np.cumsum(np.r_[0, self.byte_lengths[ids]])[np.cumsum(np.r_[0, lengths])]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key`` and ``ids array<int>``: whole texts encoded with the tokenizer file ``path``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = binary(part.column("text")).cast(pa.large_string()).to_pylist()
                ids, lengths = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(pa.array(ids), lengths)], [key, "ids"])

    source = docs.select(docs[key].alias(key), docs[column].alias("text"))
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and ``text``: the text that each row's ids stand for."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(1)
                lengths = np.array(lists.value_lengths().fill_null(0), np.int64)
                texts = bpe.decode(np.array(lists.flatten(), np.int64), lengths)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], [key, "ids", "text"])

    source = encoded.select(key, "ids")
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, ids array<int>, text string")


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """What ``decode`` gives for ``encode``, in one function: a task needs one Python worker, not two."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lengths = bpe.encode(binary(part.column("text")).cast(pa.large_string()).to_pylist())
                columns = [part.column(0), list_array(pa.array(ids), lengths), pa.array(bpe.decode(ids, lengths), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "text"])

    source = docs.select(docs[key].alias(key), docs[column].alias("text"))
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, ids array<int>, text string")
