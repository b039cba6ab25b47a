"""Near-duplicate embeddings: int8 tile products with rigorous error bounds.

Equal vectors are first taken together. The distinct ones are dealt to cells by their nearest
pivot; large cells are cut into blocks and small ones share blocks, of at most about ``block``
vectors or, in larger tables, a sixth of the table up to 8 MiB. A vector meets only blocks it
can reach: by the triangle inequality of angles, a partner in a cell is no further from the
cell's pivot than the cell's radius. A tile holds the vectors of two blocks; one product of
their int8 codes also adds up their quantisation errors, which bound the distance to the true
cosine, rounding included. Pairs surely above or below need nothing more, and only the rest
are computed again in double precision. A tile returns a count per vector and a spanning forest
of its links, never the pairs.

No link is lost: all pairs of vectors that could reach each other share one tile. On data
without any structure every block reaches every other, so the work is that of all pairs, at
about a nanosecond or two a pair, and rows dealt to tiles are as many as vectors times blocks.

Defined cases: null, zero and not finite vectors, vectors with null components, and rows
with a null vec_id link with nothing; vectors of different length don't link; rows that share
vec_id and vector count as vectors of their own, rows that share vec_id only as one node
whose links are added up; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.llm.components import components
from wallscope.session import materialize

BLOCK, PIVOTS = 2048, 64
#: Blocks grow with the table to about this many, then to so many bytes of vectors, so that vectors are dealt to few tiles.
BLOCKS, LARGEST = 6, 8 << 20
#: Most tasks for the tiles.
TASKS = 4096
#: Room for rounding in double precision, far above what dot products of unit vectors need.
SLACK = 1e-9
CHUNK = 1 << 16


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, and the length of what the codes miss."""
    scale = np.abs(rows).max(1) / 127
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    missed = np.linalg.norm(rows - codes * scale[:, None], axis=1) + SLACK
    return codes, scale, missed


def links(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b with a cosine of ``least`` or more; if both are the same rows, i < j only."""
    a, b = unit(a), unit(b)
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    # With ea at its largest the bound is a sum of two terms, which two more columns add to the product.
    eb = eb * (1 + 3 * ea.max())
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    left = np.c_[qa * sa[:, None], ea, np.ones(len(a))].astype(kind)
    right = np.c_[qb * sb[:, None], np.ones(len(b)), eb].astype(kind).T
    # Above the rounding of the factors, the products and their sums, whose sizes add up to 4 at most.
    room = SLACK + 4 * (a.shape[1] + 8) * np.finfo(kind).eps
    found_i, found_j = [], []
    for start in range(0, len(a), 256):
        first = start if same else 0
        near = left[start : start + 256] @ right[:, first:]
        if same:
            head = near[:, : len(near)]
            head[np.tri(len(near), dtype=bool)] = -2
        i, j = np.divmod(np.flatnonzero(near >= least - room), near.shape[1])
        sure = near[i, j] - 2 * (ea[i + start] + eb[j + first]) >= least + room
        i, j = i + start, j + first
        for at in range(0, len(i), CHUNK):
            open_ = np.flatnonzero(~sure[at : at + CHUNK]) + at
            sure[open_] = np.einsum("ij,ij->i", a[i[open_]], b[j[open_]]) >= least
        found_i.append(i[sure])
        found_j.append(j[sure])
    return np.concatenate(found_i), np.concatenate(found_j)


def roots(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index in each node's component."""
    label = np.arange(nodes)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _tile(least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        dim = int(group["dim"].iloc[0])
        parts = [group[group["side"] == s] for s in (0, 1)]
        a, b = (np.frombuffer(b"".join(p["vec"]), np.float64).reshape(-1, dim) for p in parts)
        same = bool(group["same"].iloc[0])
        if not len(a) or not (same or len(b)):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        i, j = links(a, a if same else b, least, same)
        ids = np.r_[parts[0]["rep"], parts[1]["rep"]].astype(np.int64)
        copies = np.r_[parts[0]["copies"], parts[1]["copies"]].astype(np.int64)
        j = j if same else j + len(a)
        count = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        label = roots(len(ids), i, j)
        touched = count > 0
        return pd.DataFrame({"a": ids[touched], "b": ids[label[touched]], "links": count[touched].astype(np.int64)})

    return run


def _cells(distinct: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rep, copies, vec (doubles), dim, cell (nearest pivot of that length) and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column("embedding").to_pylist()]
            cell, angle = np.zeros(len(vectors), np.int32), np.full(len(vectors), math.pi)
            dims = np.array([len(v) for v in vectors], np.int32)
            for dim in set(dims.tolist()) & pivots.keys():
                at = np.flatnonzero(dims == dim)
                angles = np.arccos(np.clip(unit(np.stack([vectors[k] for k in at])) @ pivots[dim].T, -1, 1))
                cell[at], angle[at] = angles.argmin(1), angles.min(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), pa.array([v.tobytes() for v in vectors], pa.binary()), *map(pa.array, (dims, cell, angle))],
                ["rep", "copies", "vec", "dim", "cell", "angle"],
            )

    return distinct.mapInArrow(run, "rep bigint, copies bigint, vec binary, dim int, cell int, angle double")


def _blocks(cells: list, pivots: dict[int, np.ndarray], size: int) -> tuple[list, int]:
    """(dim, cell, radius, first block, blocks) of every (dim, cell, radius, rows), and the number of blocks.

    Large cells are cut into blocks of about ``size`` rows; small ones share a block, each with
    those whose pivots are nearest.
    """
    table, total = [], 0
    for dim in sorted({c[0] for c in cells}):
        left = {c[1]: c for c in cells if c[0] == dim}
        at, room = None, 0
        while left:
            near = pivots[dim] @ pivots[dim][at] if at is not None and dim in pivots else None
            at = min(left) if near is None else max(left, key=lambda c: (near[c], -c))
            _, _, radius, rows = left.pop(at)
            if rows > room:
                first, blocks = total, math.ceil(rows / size)
                total, room = total + blocks, size if rows <= size else 0
            table.append((dim, at, radius, first, blocks))
            room -= min(rows, room)
    return table, total


def _deal(cells: DataFrame, pivots: dict[int, np.ndarray], table: list, total: int, reach: float) -> DataFrame:
    """A row per vector and tile; ``table`` has (dim, cell, radius, first block, blocks), a row per cell."""
    by_dim: dict[int, list] = {}
    for row in table:
        by_dim.setdefault(row[0], []).append(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rep").to_numpy()
            dims, cell = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            vecs = batch.column("vec").to_pylist()
            # Which of the blocks of its cell a vector is in.
            turn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = np.zeros(len(at), np.int64)
                for _, c, _, first, blocks in by_dim[dim]:
                    mine = cell[at] == c
                    own[mine] = first + (turn[at][mine] % np.uint64(blocks)).astype(np.int64)
                angles = np.zeros((len(at), 1))
                if dim in pivots:
                    rows = unit(np.stack([np.frombuffer(vecs[k], np.float64) for k in at]))
                    angles = np.arccos(np.clip(rows @ pivots[dim].T, -1, 1))
                # A vector meets a block if it can reach any of the block's cells.
                reached: dict[int, np.ndarray] = {}
                for _, c, radius, first, blocks in by_dim[dim]:
                    near = angles[:, c if dim in pivots else 0] <= radius + reach
                    for block in range(first, first + blocks):
                        reached[block] = reached[block] | near if block in reached else near
                for block, hit in reached.items():
                    near = np.flatnonzero(hit)
                    low, high = np.minimum(own[near], block), np.maximum(own[near], block)
                    take = pa.array(at[near])
                    for k in range(0, len(near), 4096):
                        cut = slice(k, k + 4096)
                        rows = batch.select(["rep", "copies", "vec", "dim"]).take(take[cut])
                        yield pa.RecordBatch.from_arrays(
                            [*rows.columns, *map(pa.array, (low[cut] * total + high[cut], (own[near][cut] > block).astype(np.int32), low[cut] == high[cut]))],
                            ["rep", "copies", "vec", "dim", "tile", "side", "same"],
                        )

    return cells.mapInArrow(run, "rep bigint, copies bigint, vec binary, dim int, tile bigint, side int, same boolean")


def near_duplicates(vectors: DataFrame, least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    grouped = rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = materialize(grouped, "vectors")
    count = distinct.count()
    wanted = min(PIVOTS, math.ceil(count / block))
    drawn = distinct.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(r["embedding"]) for r in drawn}:
        pivots[dim] = unit(np.array([r["embedding"] for r in drawn if len(r["embedding"]) == dim]))
    cells = materialize(_cells(distinct, pivots), "cells")
    found = cells.groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    longest = max([1, *(r["dim"] for r in found)])
    size = max(block, min(math.ceil(count / BLOCKS), LARGEST // (8 * longest)))
    table, total = _blocks([(r["dim"], r["cell"], r["radius"] + SLACK, r["n"]) for r in found], pivots, size)
    if table:
        dealt = _deal(cells, pivots, table, total, math.acos(least) + 1e-6)
        # Tiles are small in bytes and large in work, so size alone would put too many into a task.
        dealt = dealt.repartition(min(total * (total + 1) // 2, TASKS), "tile")
        found = dealt.groupBy("tile").applyInPandas(_tile(least), "a bigint, b bigint, links bigint")
    else:
        found = distinct.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("copies").alias("links"))
    found = materialize(found, "tiles")
    groups = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = distinct.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(
        "embedding",
        F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    linked = rows.where(sound).join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
