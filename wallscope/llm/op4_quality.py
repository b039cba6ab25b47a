"""Quality classifier by co-training of a content view and a page-metadata view.

The content view sees the text only: frequencies of neighbouring character classes, and how
much its words repeat. The metadata view sees source, language, length and line layout.
Each is a logistic regression; over some rounds each labels the pool documents it is most
sure of, and the other learns from them. Both are then calibrated on labelled documents kept
out of training, and a last regression combines the two calibrated views. All documents are
scored in one narrow stage without a shuffle.

The model is fitted on about ``labelled`` of the labelled documents that the corpus holds,
and a pool of about ``pool`` others, drawn by a hash of doc_id; only their feature vectors
reach the driver. Labels of documents outside the corpus play no part.

Defined cases: a null text counts as an empty one, null source or lang as a value of its
own; documents with contradicting labels are not learned from; without labels of both kinds
every document is kept with score 1; ties (a score of exactly 0.5) are kept; repeated rows
and rows with a null doc_id are each scored by their own text, and of the rows that share a
doc_id at most one is learned from; an empty table gives no rows. A very long text is taken
on its own and needs about 60 times its size while its features are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.llm.arrow import bound_batches, flat_bytes, slices
from wallscope.llm.words import word_hashes
from wallscope.session import materialize

LABELLED, POOL = 12_000, 6_000
ROUNDS, SURE, GROWTH = 4, 0.98, 200
#: Bytes of texts whose features a task computes at once; each takes about 60 bytes of temporary arrays.
TEXT_BYTES = 1 << 18
#: Character classes: letters, digits, blanks, line ends, frequent marks, rest, and parts of characters beyond ASCII.
CLASSES = np.full(256, 9, np.uint8)
for _class, _members in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t", b"\r\n", b".,;:", b"!?", b"|<>[]{}", b"*#$%&=+_~"]):
    CLASSES[list(_members)] = _class
CLASSES[128:192], CLASSES[192:] = 10, 11
KINDS, HASHED = 12, 16
CONTENT, META = KINDS * KINDS + 3, 2 * HASHED + 5


def content_view(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of class pairs; shares of repeated words; word length."""
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    kind = CLASSES[flat].astype(np.int64)
    row = np.repeat(np.arange(rows), lengths)
    same = row[:-1] == row[1:]
    codes = (row[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:])[same]
    pairs = np.bincount(codes, minlength=rows * KINDS * KINDS).reshape(rows, -1)
    out = np.zeros((rows, CONTENT), np.float32)
    out[:, :-3] = np.sqrt(pairs / np.maximum(pairs.sum(1), 1)[:, None])
    words, counts = word_hashes(flat, offsets)
    owner = np.repeat(np.arange(rows), counts)
    twice = (words[:-1] == words[1:]) & (owner[:-1] == owner[1:])
    order = np.lexsort((words, owner))
    fresh = np.r_[True, (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(words)]
    most = np.maximum(counts, 1)
    out[:, -3] = np.bincount(owner[:-1][twice], minlength=rows) / most
    # Longer texts repeat words anyway; the root keeps the scale alike.
    out[:, -2] = np.bincount(owner[order][fresh], minlength=rows) / most**0.7
    out[:, -1] = np.log1p(lengths / most)
    return out


def meta_view(flat: np.ndarray, offsets: np.ndarray, sources: list, langs: list) -> np.ndarray:
    """Hashed source and language, length and line layout."""
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, META), np.float32)
    for shift, values in ((0, sources), (HASHED, langs)):
        places = [crc32(repr(v).encode()) % HASHED for v in values]
        out[np.arange(rows), shift + np.array(places, np.int64)] = 1
    breaks = np.flatnonzero(flat == 10)
    lines = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    owner = np.repeat(np.arange(rows), lengths)
    edges = np.unique(np.r_[offsets[:-1], breaks + 1, len(flat)])
    edges = edges[edges <= len(flat)]
    spans, heads = np.diff(edges), edges[:-1]
    longest = np.zeros(rows)
    if len(heads):
        np.maximum.at(longest, owner[np.minimum(heads, len(flat) - 1)], spans)
    blank = np.bincount(owner[breaks[1:][np.diff(breaks) == 1]], minlength=rows) if len(breaks) > 1 else np.zeros(rows)
    out[:, -5:] = np.stack([np.log1p(lengths), np.log1p(lines), np.log1p(lengths / lines), np.log1p(longest), blank / lines], 1)
    return out


class Logistic(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> Logistic:
    """Logistic regression by Newton steps."""
    x = x.astype(np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    design = np.c_[(x - mean) / scale, np.ones(len(x))]
    weights = np.zeros(design.shape[1])
    penalty = np.r_[np.full(design.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = sigmoid(np.clip(design @ weights, -30, 30))
        slope = design.T @ (p - y) + penalty * weights
        curve = (design * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, weights)


class Model(NamedTuple):
    views: tuple[Logistic, Logistic]
    scales: tuple[Logistic, Logistic]
    last: Logistic

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and of their combination."""
        logits = [s.logit(v.logit(x)[:, None]) for v, s, x in zip(self.views, self.scales, views)]
        both = sigmoid(self.last.logit(np.stack(logits, 1)))
        return sigmoid(logits[0]), sigmoid(logits[1]), both


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> Model | None:
    """Rounds of exchange, then calibration and combination on every third labelled row."""
    held = np.arange(len(y)) % 3 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    own = [(x[~held], y[~held]) for x in views]
    left = np.ones(len(pool[0]), bool)
    for _ in range(ROUNDS):
        models = [train(*o) for o in own]
        gained = 0
        for k, model in enumerate(models):
            p = sigmoid(model.logit(pool[k]))
            for label, sure in ((1, p), (0, 1 - p)):
                found = np.flatnonzero(left & (sure >= SURE))
                found = found[np.argsort(-sure[found], kind="stable")][:GROWTH]
                left[found] = False
                x, labels = own[1 - k]
                own[1 - k] = np.r_[x, pool[1 - k][found]], np.r_[labels, np.full(len(found), label)]
                gained += len(found)
        if not gained:
            break
    models = tuple(train(*o) for o in own)
    raw = [m.logit(x[held])[:, None] for m, x in zip(models, views)]
    scales = tuple(train(r, y[held]) for r in raw)
    last = train(np.stack([s.logit(r) for s, r in zip(scales, raw)], 1), y[held])
    return Model(models, scales, last)


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = flat_bytes(part.column("text"))
    meta = meta_view(flat, offsets, part.column("source").to_pylist(), part.column("lang").to_pylist())
    return content_view(flat, offsets), meta


def _one_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id, the same one however rows are dealt."""
    mark = F.struct(F.xxhash64("text", "source", "lang"), "text", "source", "lang")
    return rows.groupBy("doc_id").agg(F.min(mark).alias("least")).select("doc_id", "least.text", "least.source", "least.lang")


def _features(rows: DataFrame) -> pd.DataFrame:
    """doc_id and both views of bounded sample rows, on the driver."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                both = [pa.array([r.tobytes() for r in v], pa.binary()) for v in _views(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *both], ["doc_id", "content", "meta"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, content binary, meta binary").toPandas()


def _drawn(rows: DataFrame, wanted: int) -> pd.DataFrame:
    """About ``wanted`` of the rows, at most twice as many, by a hash of doc_id in the column ``draw``."""
    total = rows.count()
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40)))
    some = rows if total <= wanted else rows.where(F.col("draw") < int((1 << 40) * wanted / total))
    return some.limit(2 * wanted).toPandas()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    own = docs.select("doc_id", "text", "source", "lang")
    present = materialize(own.select("doc_id").where("doc_id IS NOT NULL").distinct(), "present")
    known = materialize(known.where("y IN (0, 1)").join(present, "doc_id", "left_semi"), "labelled")
    known, others = _drawn(known, labelled), _drawn(present, pool)
    if known["y"].nunique() < 2:
        return None
    ids = pd.concat([known[["doc_id"]], others[["doc_id"]]]).drop_duplicates()
    # At most 2 * (labelled + pool) identifiers.
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, f"doc_id {dict(own.dtypes)['doc_id']}"))
    rows = _features(_one_each(own.join(wanted, "doc_id"))).merge(known, "left", "doc_id").sort_values(["draw", "doc_id"])
    sides = []
    for part in (rows[rows["y"].notna()], rows[rows["y"].isna()]):
        sides.append(
            tuple(
                np.stack([np.frombuffer(b, np.float32) for b in part[c]]) if len(part) else np.empty((0, n), np.float32)
                for c, n in (("content", CONTENT), ("meta", META))
            )
        )
    y = rows["y"].dropna().to_numpy()
    return cotrain(sides[0], y, sides[1]) if len(y) else None


def _score(rows: DataFrame, carried: list[str], model: Model | None) -> DataFrame:
    """The columns ``carried`` and the three probabilities of every row."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                found = model.score(_views(part)) if model else [np.ones(part.num_rows)] * 3
                columns = [*(part.column(c) for c in carried), *(pa.array(p, pa.float64()) for p in found)]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "content_score", "meta_score", "quality"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"{kinds}, content_score double, meta_score double, quality double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, content_score, meta_score, quality, kept."""
    found = _score(docs.select("doc_id", "text", "source", "lang"), ["doc_id"], fit(docs, labels))
    return found.withColumn("kept", F.col("quality") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that are not rejected."""
    # Texts go to Python once and come back; the other columns travel beside them.
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    found = _score(docs.select(rest, "text", "source", "lang"), ["row", "text"], fit(docs, labels))
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.where(F.col("quality") >= threshold).select(*columns)
