"""Whitening of embeddings with an exact covariance from bit-sliced cross-products.

Entries become integers. A task shifts each dimension by the minimum of its rows and packs
the bits of equal weight of all rows into 64-bit words, a plane per dimension and weight. The
sum over rows of a product of two dimensions is the sum over pairs of planes of
``2 ** (p + q)`` times the number of bits set in both, so AND and popcount give it exactly;
the shift is undone in integers. Tasks return sums only, one row per pair of dimensions, and
Spark adds them up. The driver centres them as integers, divides once, and takes ``eigh``.

Sums don't depend on how rows are dealt, so the components don't either. Three narrow scans:
sums, covariance of what was whitened, result.

Defined cases: rows with a null or empty vector or with null or non-finite entries are left
out; vectors of different length are fitted apart, each length on its own rows; repeated rows
and repeated or null vec_ids count as rows of their own; entries beyond +-2**42 count as that
bound; a direction without variance has ``whitened`` and ``explained`` 0 and stays out of
``identity_error``; ``deviation`` is null where it exceeds a long, and is in any case given as
decimal digits in ``deviation_text``; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Largest size of a scaled entry.
BOUND = float(1 << 52)
#: Rows whose bits are packed together, 64 to a word.
ROWS = 8192
#: Sums travel as limbs of so many bits, so that longs hold the sums of any number of tasks.
LIMB, LIMBS = 40, 5
#: Eigenvalues below this share of the largest are rounding.
FLAT = 1e-13


def integers(vectors: np.ndarray) -> np.ndarray:
    """The integer form of finite vectors (rows x dimensions)."""
    return np.floor(np.clip(vectors * float(SCALE), -BOUND, BOUND)).astype(np.int64) + SHIFT


def planes(shifted: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers (rows x dimensions): dimensions x bits x words of 64 rows."""
    rows, dims = shifted.shape
    bits = max(1, int(shifted.max()).bit_length())
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = shifted
    out = np.empty((dims, bits, len(padded) // 64), np.uint64)
    for p in range(bits):
        packed = np.packbits(((padded >> p) & 1).astype(np.uint8), axis=0)
        out[:, p] = np.ascontiguousarray(packed.T).view(np.uint64)
    return out


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of all pairs of dimensions, as Python integers."""
    dims, low = x.shape[1], x.min(0)
    sliced = planes(x - low)
    bits, flat = sliced.shape[1], sliced.reshape(-1, sliced.shape[2])
    weighted = np.zeros((2 * bits - 1, dims, dims), np.int64)
    for d in range(dims):
        for p in range(bits):
            own = flat[d * bits + p]
            if own.any():
                # Only dimensions from d on: the rest follows by symmetry.
                common = np.bitwise_count(flat[d * bits :] & own).sum(1, dtype=np.int64).reshape(dims - d, bits)
                weighted[p : p + bits, d, d:] += common.T
    total = np.zeros((dims, dims), object)
    for s in range(2 * bits - 1):
        total += weighted[s].astype(object) * (1 << s)
    total = np.triu(total) + np.triu(total, 1).T
    sums, low = (x - low).sum(0).astype(object), low.astype(object)
    return total + np.outer(sums, low) + np.outer(low, sums) + len(x) * np.outer(low, low)


def _limbs(values: list[int]) -> list[pa.Array]:
    """Longs whose weighted sum is the value; the last one carries the sign."""
    mask = (1 << LIMB) - 1
    parts = [[(v >> (LIMB * k)) & mask for v in values] for k in range(LIMBS - 1)]
    return [pa.array(p, pa.int64()) for p in [*parts, [v >> (LIMB * (LIMBS - 1)) for v in values]]]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each vector length, and their vectors in double precision."""
    column = batch.column("embedding")
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(np.float64, copy=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        for k in range(0, len(at), ROWS):
            some = at[k : k + ROWS]
            yield some, flat[starts[some][:, None] + np.arange(dim)]


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that can be used."""
    usable = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))"
    return vectors.where(usable).select("vec_id", "embedding")


def _sums(rows: DataFrame) -> DataFrame:
    """dim, i, j and limbs: products of dimensions i <= j, sums of dimension j at i = -1, rows at i = j = -1."""
    names = [f"limb{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, vectors in _by_length(batch):
                x = integers(vectors)
                own = held.setdefault(x.shape[1], [0, 0, 0])
                own[0] += len(x)
                own[1] += x.astype(object).sum(0) if np.abs(x).max() > 1 << 48 else x.sum(0).astype(object)
                own[2] += cross_products(x)
        for dim, (n, sums, products) in held.items():
            i, j = np.triu_indices(dim)
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            places = [np.r_[-1, np.full(dim, -1), i], np.r_[-1, np.arange(dim), j]]
            where = [pa.array(np.full(len(values), dim, np.int32)), *(pa.array(p.astype(np.int32)) for p in places)]
            yield pa.RecordBatch.from_arrays([*where, *_limbs(values)], ["dim", "i", "j", *names])

    shape = ", ".join(f"{n} bigint" for n in names)
    found = rows.select("embedding").mapInArrow(run, f"dim int, i int, j int, {shape}")
    return found.groupBy("dim", "i", "j").agg(*[F.sum(n).alias(n) for n in names])


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    #: Columns are unit eigenvectors over the root of their eigenvalue (0 for directions without variance).
    matrix: np.ndarray
    explained: list[float]
    flat: list[bool]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer rows."""
        mean = [Fraction(s, self.n) for s in self.sums]
        # The whole part is taken off in integers, so nothing cancels in double precision.
        whole = [int(m) for m in mean]
        rest = np.array([float(m - w) for m, w in zip(mean, whole)])
        return ((x - np.array(whole, np.int64)).astype(np.float64) - rest) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n * x - S) ** 2."""
        largest = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if largest < 1 << 62:
            gap = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(gap).max()) ** 2 * x.shape[1] < 1 << 63:
                return (gap * gap).sum(1).tolist()
        gap = x.astype(object) * self.n - np.array(self.sums, object)
        return (gap * gap).sum(1).tolist()


def fit(rows: DataFrame) -> dict[int, Whitening]:
    """A whitening per vector length. Reaches the driver: the sums of pairs of dimensions, whatever the row count."""
    held: dict[int, dict[tuple[int, int], int]] = {}
    for r in _sums(rows).collect():
        held.setdefault(r["dim"], {})[r["i"], r["j"]] = sum(r[f"limb{k}"] << (LIMB * k) for k in range(LIMBS))
    out = {}
    for dim, totals in held.items():
        n, sums = totals[-1, -1], [totals[-1, j] for j in range(dim)]
        covariance = np.empty((dim, dim))
        for i in range(dim):
            for j in range(i, dim):
                centred = Fraction(n * totals[i, j] - sums[i] * sums[j], n * n)
                covariance[i, j] = covariance[j, i] = float(centred)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        use = slice(0, min(COMPONENTS, dim))
        trace = float(np.trace(covariance))
        flat = values[use] <= max(values[0], 0) * FLAT
        kept = np.where(flat, 1, values[use])
        matrix = np.where(flat, 0, vectors[:, use] / np.sqrt(kept))
        explained = [0.0 if f else float(e / trace) for e, f in zip(values[use], flat)]
        out[dim] = Whitening(n, sums, matrix, explained, flat.tolist())
    return out


def identity_errors(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of the measured covariance of whitened rows minus the identity, per vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, vectors in _by_length(batch):
                w = models[vectors.shape[1]].apply(integers(vectors))
                own = held.setdefault(vectors.shape[1], [0.0, 0.0])
                own[0] += w.sum(0)
                own[1] += w.T @ w
        for dim, (sums, products) in held.items():
            size = len(sums)
            i, j = np.divmod(np.arange(size * size), size)
            places = [np.full(size * (size + 1), dim), np.r_[np.full(size, -1), i], np.r_[np.arange(size), j]]
            values = pa.array(np.r_[sums, products.ravel()])
            yield pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int32)) for p in places), values], ["dim", "i", "j", "value"])

    found = rows.select("embedding").mapInArrow(run, "dim int, i int, j int, value double")
    totals: dict[int, dict[tuple[int, int], float]] = {}
    for r in found.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        totals.setdefault(r["dim"], {})[r["i"], r["j"]] = r["value"]
    out = {}
    for dim, model in models.items():
        used = [k for k, f in enumerate(model.flat) if not f]
        gap = 0.0
        for i in used:
            for j in used:
                own = totals[dim]
                covariance = own[i, j] / model.n - own[-1, i] / model.n * own[-1, j] / model.n
                gap = max(gap, abs(covariance - (i == j)))
        out[dim] = gap
    return out


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_text."""
    rows = sound(vectors)
    models = fit(rows)
    errors = identity_errors(rows, models)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in _by_length(batch):
                dim = found.shape[1]
                model, x = models[dim], integers(found)
                w = model.apply(x)
                count, size = w.shape
                exact = model.deviations(x)
                row = np.repeat(np.arange(count), size)
                columns = {
                    "vec_id": batch.column("vec_id").take(pa.array(at[row])),
                    "component": pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    "n": pa.array(np.full(count * size, model.n)),
                    "deviation": pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()).take(pa.array(row)),
                    "whitened": pa.array(w.ravel()),
                    "explained": pa.array(np.tile(model.explained, count)),
                    "identity_error": pa.array(np.full(count * size, errors[dim])),
                    "deviation_text": pa.array([str(d) for d in exact], pa.string()).take(pa.array(row)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(
        run,
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string",
    )
