"""Helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a batch that goes to Python, unless the session sets a bound of its own.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that a task works on at once; bounds the temporary arrays, not the result.
SLICE_BYTES = 1 << 20
#: Bytes of text in a batch of compressed rows.
PACK_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of whole texts that tasks exchange with Python: ten thousand rows may be anything."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def binary(column: pa.Array) -> pa.Array:
    """A string or binary column as large_binary without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` bytes of ``column``, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(offsets_of(binary(batch.column(column)))))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(values: pa.LargeBinaryArray) -> np.ndarray:
    """The n + 1 offsets of the rows of a large_binary array in its buffer."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column end to end, and the n + 1 offsets of its rows."""
    values = binary(column)
    offsets = offsets_of(values)
    data = values.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def list_array(flat: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """A list column from its flat values and the length of every row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def pack(rows: DataFrame) -> DataFrame:
    """The column ``text`` as compressed bytes in ``packed``, for a smaller shuffle; other columns stay."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in (part for whole in batches for part in slices(whole, "text", PACK_BYTES)):
            packed = pa.array((packer.compress((t.as_py() or "").encode()) for t in batch.column("text")), pa.binary(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), packed], [*names, "packed"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, packed binary")
