"""Language identification with string kernels.

A text is the set of its byte n-grams of one to four bytes (blended spectrum, presence
only), hashed to ``DIMENSIONS`` places. The kernel of two texts is the size of the
intersection over the geometric mean of their sizes. Nyström landmarks turn it into finite
features, on which one-versus-rest kernel ridge regression is solved in closed form.
Scoring is one narrow stage of batched matrix products: presence x landmarks x weights.

The model learns from every language that labels name, from at most ``per_language``
documents of each and about ``sample_rows`` in all, drawn by a hash of doc_id; only their
presence bits reach the driver, which works on them in blocks. Each language has a landmark
at least. Every row is scored on its whole text; lang, source and doc_id are not inputs.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, and if nothing
could be learned; rows with a null doc_id are scored but not learned from; of the rows that
share a doc_id at most one is learned from, and each is scored; ties go to the
alphabetically first language; an empty table gives no rows; other columns are left out. A
very long text is taken on its own and needs about 60 times its size while it is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.llm.arrow import binary, bound_batches, slices
from wallscope.llm.words import STEP

DIMENSIONS = 8192
GRAMS = 4
PER_LANGUAGE, SAMPLE_ROWS, LANDMARKS = 400, 100_000, 192
#: Texts whose presence vectors a task holds at once.
BLOCK = 256
ASCII_LETTER = re.compile(rb"[A-Za-z]")
LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits, a row per landmark
    weights: np.ndarray  # landmarks x languages


def presence(texts: list[bytes]) -> np.ndarray:
    """A row of 0 and 1 per text: which hashed n-grams occur in it."""
    lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    flat = np.frombuffer(b"".join(lowered), np.uint8).astype(np.uint64)
    lengths = np.array([len(t) for t in lowered])
    row = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    code = np.zeros(len(flat), np.uint64)
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    for n in range(1, GRAMS + 1):
        code = code[: len(flat) - n + 1] * np.uint64(256) + flat[n - 1 :]
        whole = left[: len(code)] >= n
        place = ((code + np.uint64(n << 40)) * STEP) >> shift
        out[row[: len(code)][whole], place[whole]] = 1
    return out


def kernel(texts: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised intersection sizes of presence rows."""
    norms = np.sqrt(np.maximum(texts.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))
    return texts @ landmarks.T / norms


def unpack(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=DIMENSIONS).astype(np.float32)


def solve(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """Nyström features of the landmarks (spread over the languages) and ridge regression on them.

    There are ``landmarks`` of them or as many as languages. Rows are unpacked in blocks, so
    memory is that of the landmarks and of one block.
    """
    languages, target = np.unique(np.array(langs, object), return_inverse=True)
    turn = np.empty(len(langs), np.int64)
    for k in range(len(languages)):
        own = np.flatnonzero(target == k)
        turn[own] = np.arange(len(own))
    chosen = np.lexsort((target, turn))[: max(landmarks, len(languages))]
    marks = unpack(bits[chosen])
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    share = np.bincount(target)
    weights = (len(target) / (len(languages) * share))[target]
    gram = ridge * len(target) * np.eye(root.shape[1])
    right = np.zeros((root.shape[1], len(languages)))
    for start in range(0, len(bits), BLOCK):
        rows = slice(start, start + BLOCK)
        features = kernel(unpack(bits[rows]), marks) @ root
        weighted = features * weights[rows, None]
        gram += features.T @ weighted
        # Signs are 1 for the row's language and -1 for all others.
        right -= weighted.sum(0)[:, None]
        np.add.at(right.T, target[rows], 2 * weighted)
    solution = np.linalg.solve(gram, right)
    return Model(languages.tolist(), bits[chosen], (root @ solution).astype(np.float32))


def has_letter(raw: bytes) -> bool:
    return bool(ASCII_LETTER.search(raw)) or bool(LETTER.search(raw.decode("utf-8", "replace")))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from the documents with a language whose crc32(doc_id) mod 3 is not 1; None without any."""
    bound_batches(docs.sparkSession)
    own = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    own = own.where(F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    # A row per language.
    counts = own.groupBy("lang").count().toPandas()
    if not len(counts):
        return None
    most = max(1, min(per_language, sample_rows // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # A fifth more than asked for, as a hash doesn't hit the share exactly; the rest is cut off below.
    counts["share"] = np.minimum(1.0, 1.2 * most / counts["count"])
    share = docs.sparkSession.createDataFrame(counts[["lang", "share"]], "lang string, share double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for start in range(0, part.num_rows, BLOCK):
                    cut = part.slice(start, BLOCK)
                    bits = np.packbits(presence(binary(cut.column("text")).to_pylist()).astype(bool), axis=1)
                    rows = pa.array([b.tobytes() for b in bits], pa.binary())
                    yield pa.RecordBatch.from_arrays([cut.column("draw"), cut.column("lang"), rows], ["draw", "lang", "bits"])

    sample = own.withColumn("draw", draw).join(F.broadcast(share), "lang").where("draw < share")
    one = F.min(F.struct("draw", "lang", "text")).alias("one")
    sample = sample.groupBy("doc_id").agg(one).select("one.*")
    drawn = sample.mapInArrow(run, "draw double, lang string, bits binary").limit(2 * most * len(counts)).toPandas()
    drawn = drawn.sort_values(["draw", "lang", "bits"]).groupby("lang").head(most)
    bits = np.stack([np.frombuffer(b, np.uint8) for b in drawn["bits"]])
    return solve(bits, drawn["lang"].tolist())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = unpack(model.landmarks) if model else None
        for batch in batches:
            for part in slices(batch, "text"):
                for start in range(0, part.num_rows, BLOCK):
                    cut = part.slice(start, BLOCK)
                    texts = binary(cut.column("text")).to_pylist()
                    names, scores = ["und"] * len(texts), [0.0] * len(texts)
                    use = [i for i, t in enumerate(texts) if model and has_letter(t)]
                    if use:
                        values = kernel(presence([texts[i] for i in use]), marks) @ model.weights
                        for i, k, v in zip(use, values.argmax(1), values.max(1)):
                            names[i], scores[i] = model.languages[k], float(np.clip((v + 1) / 2, 0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [cut.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"]
                    )

    source = docs.select("doc_id", "text")
    scored = source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, lang_pred string, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, fit(docs, per_language))
