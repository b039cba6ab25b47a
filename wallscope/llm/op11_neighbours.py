"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample: k-means splits a node into up to ``BRANCH`` children
until a leaf stands for about ``LEAF`` rows. Every row goes down to a leaf. A query keeps a
priority queue of nodes, ordered by a lower bound of the distance to their cell (the
hyperplanes between a child and the nearest one), and visits leaves in that order. How many
is calibrated: some queries are compared with all rows, and visits are widened until the
leaves visited hold at least ``TARGET`` of their true neighbours. If it takes all leaves, the
search is exact.

Queries and leaves meet in tiles of bounded size, so a leaf with very many rows is many
tiles. Equal vectors are one row of the index with its ``k + 1`` smallest identifiers, all
that can be among the ``k`` nearest. Distances are computed directly from the original
vectors in double precision.

Bounded samples, all parameters: ``SAMPLE`` rows for the tree, ``CALIBRATION`` queries.
Every row is indexed and every query answered.

Defined cases: null, empty, zero and not finite vectors, vectors with null components and
rows with a null identifier take no part; vectors of different length are no candidates for
each other; rows that share an identifier are one candidate, at its smallest distance; an
identifier is never its own candidate; ties go to the smaller identifier; with fewer than
``k`` candidates all are returned; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscope.llm.tiles import dealt, tiled
from wallscope.session import materialize

SAMPLE, CALIBRATION, TARGET = 16_384, 256, 0.97
BRANCH, LEAF, LEAST = 16, 512, 8
#: Rows of a leaf and queries that meet in one tile.
BLOCK, QUERIES = 4096, 1024
#: Parts in which the identifiers of one vector are cut down before they come together.
SALTS = 16
ROUNDS, SEED = 8, 11


class Tree(NamedTuple):
    """Nodes in order of creation, the root first; ``leaf`` is -1 for inner nodes."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    #: Distances between the children of a node.
    apart: list[np.ndarray]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child on every level."""
        out = np.empty(len(x), np.int64)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = np.array(self.children[node])
            nearest = squares(x[rows], self.centres[own]).argmin(1)
            work += [(int(own[k]), rows[nearest == k]) for k in np.unique(nearest)]
        return out

    def visits(self, x: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each query its first ``most`` leaves, best bin first."""
        for row, gaps in zip(x, squares(x, self.centres).tolist()):
            queue, found = [(0.0, 0.0, 0)], []
            while queue and len(found) < most:
                bound, _, node = heapq.heappop(queue)
                if self.leaf[node] >= 0:
                    found.append(self.leaf[node])
                    continue
                own = self.children[node]
                best = min(range(len(own)), key=lambda k: gaps[own[k]])
                for k, child in enumerate(own):
                    beyond = (gaps[child] - gaps[own[best]]) / (2 * self.apart[node][k][best]) if k != best else 0.0
                    heapq.heappush(queue, (max(bound, beyond), gaps[child], child))
            yield found


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b; for choosing only, as small ones lose digits."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the cluster of each row; clusters that got empty or equal are left out."""
    centres = np.unique(x[random.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(ROUNDS):
        nearest = squares(x, centres).argmin(1)
        used, nearest = np.unique(nearest, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, nearest, x)
        centres = np.unique(sums / np.bincount(nearest)[:, None], axis=0)
    return centres, squares(x, centres).argmin(1)


def grow(x: np.ndarray, points: int, first: int) -> Tree:
    """A tree over the sample whose leaves hold at most about ``points`` sample rows; leaves count from ``first``."""
    random = np.random.default_rng(SEED)
    centres, children, leaf, apart = [x.mean(0)], [[]], [-1], [np.zeros((0, 0))]
    work = [(0, x)]
    while work:
        node, rows = work.pop()
        parts = []
        if len(rows) > points:
            middle, cluster = kmeans(rows, min(BRANCH, -(-len(rows) // points)), random)
            parts = [(middle[k], rows[cluster == k]) for k in range(len(middle)) if (cluster == k).any()]
        if len(parts) < 2:
            leaf[node], first = first, first + 1
            continue
        middle = np.stack([c for c, _ in parts])
        apart[node] = np.maximum(np.sqrt(squares(middle, middle)), 1e-300)
        for c, own in parts:
            children[node].append(len(centres))
            work.append((len(centres), own))
            centres.append(c)
            children.append([])
            leaf.append(-1)
            apart.append(np.zeros((0, 0)))
    return Tree(np.stack(centres), children, leaf, apart)


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    finite = "forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite} AND exists(embedding, e -> e <> 0)")


def _stack(column: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the vectors in the list, and the vectors in double precision."""
    lengths = np.array([len(v) for v in column])
    return {
        int(d): (at := np.flatnonzero(lengths == d), np.stack([column[k] for k in at]).astype(np.float64))
        for d in np.unique(lengths)
    }


def _share(rows: DataFrame, wanted: int, total: int, salt: str) -> pd.DataFrame:
    """About ``wanted`` rows, at most twice as many, drawn by a hash of the vector."""
    draw = F.pmod(F.xxhash64("embedding", F.lit(salt)), F.lit(1 << 30))
    some = rows if total <= wanted else rows.where(draw < int((1 << 30) * wanted / total))
    return some.limit(2 * wanted).toPandas()


def collapse(rows: DataFrame, most: int) -> DataFrame:
    """embedding and ``ids``, the ``most`` smallest identifiers that have it."""
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("embedding", "salt").orderBy("vec_id"))
    few = salted.withColumn("rank", rank).where(F.col("rank") <= most)
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, most)
    return few.groupBy("embedding").agg(ids.alias("ids"))


def fit(rows: DataFrame) -> dict[int, Tree]:
    """A tree for each vector length in the sample; leaves of lengths beyond it are ``-length``."""
    total = rows.count()
    sample = _share(rows.select("embedding"), SAMPLE, total, "tree")
    trees, first = {}, 0
    points = max(LEAST, int(LEAF * len(sample) / max(total, 1)))
    for dim, (_, x) in _stack(sample["embedding"].tolist()).items():
        trees[dim] = grow(x, points, first)
        first = max(trees[dim].leaf) + 1
    return trees


def _placed(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """The rows with the leaf of their vector."""
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.empty(batch.num_rows, np.int64)
            for dim, (at, x) in _stack(batch.column("embedding").to_numpy(zero_copy_only=False).tolist()).items():
                leaf[at] = trees[dim].assign(x) if dim in trees else -dim
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, f"{kinds}, leaf bigint")


def _visits(queries: DataFrame, trees: dict[int, Tree], most: int) -> DataFrame:
    """A row for each query and leaf that it visits."""
    kinds = ", ".join(f"{c} {t}" for c, t in queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                at, leaves = [], []
                for dim, (places, x) in _stack(part.column("embedding").to_numpy(zero_copy_only=False).tolist()).items():
                    found = trees[dim].visits(x, most) if dim in trees else [[-dim]] * len(x)
                    for place, own in zip(places, found):
                        at.append(np.full(len(own), place))
                        leaves.append(own)
                rows = part.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(leaves).astype(np.int64))], [*rows.schema.names, "leaf"])

    return queries.mapInArrow(run, f"{kinds}, leaf bigint")


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = rows - query
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _true_leaves(index: DataFrame, queries: np.ndarray, k: int) -> pd.DataFrame:
    """For each of the bounded calibration queries (all of one length) the leaves of its k nearest other vectors."""
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k), np.inf)
        leaves = np.full((len(queries), k), -1, np.int64)
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            found = _stack(batch.column("embedding").to_numpy(zero_copy_only=False).tolist())
            if dim not in found:
                continue
            at, x = found[dim]
            for q, query in enumerate(queries):
                d = distances(x, query)
                d[d == 0] = np.inf
                all_d, all_leaves = np.r_[best[q], d], np.r_[leaves[q], leaf[at]]
                few = np.argpartition(all_d, k - 1)[:k]
                best[q], leaves[q] = all_d[few], all_leaves[few]
        q, use = np.repeat(np.arange(len(queries)), k), np.isfinite(best.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(q[use]), pa.array(leaves.ravel()[use]), pa.array(best.ravel()[use])], ["query", "leaf", "distance"]
        )

    found = index.select("embedding", "leaf").mapInArrow(run, "query bigint, leaf bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "leaf"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "leaf").toPandas()


def calibrate(index: DataFrame, queries: DataFrame, trees: dict[int, Tree], k: int, target: float = TARGET) -> int:
    """The number of leaves to visit: widened until calibration queries find ``target`` of their true neighbours."""
    sample = _share(queries.select("embedding"), CALIBRATION, queries.count(), "calibration")
    places = []
    for dim, (_, x) in _stack(sample["embedding"].tolist()).items():
        if dim not in trees:
            continue
        order = [{leaf: k for k, leaf in enumerate(own)} for own in trees[dim].visits(x, len(trees[dim].leaf))]
        true = _true_leaves(index, x, k)
        places += [order[q][leaf] for q, leaf in zip(true["query"], true["leaf"])]
    places = np.array(places, np.int64)
    most = max((sum(n >= 0 for n in t.leaf) for t in trees.values()), default=1)
    visits = 1
    while visits < most and (places < visits).mean() < target if len(places) else False:
        visits = min(most, visits + 1 + visits // 8)
    return visits


def _nearest(k: int):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(queries):
            ids = np.concatenate(members["ids"].tolist())
            owner = np.repeat(np.arange(len(members)), members["ids"].map(len))
            x = np.stack(members["embedding"].tolist()).astype(np.float64)
            for query, vector in zip(queries["query_id"].tolist(), queries["embedding"].tolist()):
                d = distances(x, vector.astype(np.float64))[owner]
                d[ids == query] = np.inf
                few = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                few = few[ids[few] != query]
                few = few[np.lexsort((ids[few], d[few]))][:k]
                out.append((np.full(len(few), query), ids[few], d[few]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest rows of ``vectors`` for the rows of ``queries``.

    Both have vec_id and embedding. Only distances count, not what ``queries`` is taken from.
    """
    asked = sound(queries).distinct().withColumnRenamed("vec_id", "query_id")
    asked = materialize(asked, "queries")
    # Of equal vectors k + 1 identifiers do: one of them may be the query's own.
    rows = materialize(collapse(sound(vectors), k + 1), "vectors")
    trees = fit(rows)
    index = materialize(_placed(rows, trees), "index")
    visits = calibrate(index, asked, trees, k, target)
    pairs = materialize(_visits(asked, trees, visits), "visits")
    members = index.withColumn("spread", F.col("ids")[0])
    left, right = tiled(members, pairs.withColumn("spread", F.col("query_id")), "leaf", BLOCK, QUERIES)
    tasks = -(-pairs.count() // QUERIES) + -(-index.count() // BLOCK)
    keys = ["leaf", "l", "r"]
    found = dealt(left, "leaf", tasks).groupBy(*keys).cogroup(dealt(right, "leaf", tasks).groupBy(*keys))
    found = found.applyInPandas(lambda a, b: _nearest(k)(a, b), "query_id bigint, vec_id bigint, score double")
    # Rows of one identifier may have lain in several tiles.
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
