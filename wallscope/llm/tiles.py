"""Pairing of two keyed tables in tiles of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.session import materialize


def tiled(left: DataFrame, right: DataFrame, key: str, most_left: int, most_right: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``key``, ``l`` and ``r``: rows of one key meet in exactly one tile (key, l, r).

    Keys with many rows are cut into blocks of about ``most_left`` and ``most_right`` rows by
    the column ``spread``, which should differ between rows; a row is repeated for each block
    of the other side. Rows whose key the other side lacks are left out.
    """
    sizes = [
        t.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        for t, most, name in ((left, most_left, "_left"), (right, most_right, "_right"))
    ]
    both = materialize(sizes[0].join(sizes[1], key), "tile-sizes")
    out = []
    for table, own, other in ((left, "l", "r"), (right, "r", "l")):
        count = {"l": "_left", "r": "_right"}
        placed = table.join(both, key).withColumn(own, F.pmod(F.xxhash64("spread"), F.col(count[own])).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(count[other]) - 1)))
        out.append(placed.drop("_left", "_right", "spread"))
    return out[0], out[1]


def dealt(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """Tiles over so many tasks; they are small in bytes and large in work, so size alone would join too many."""
    return rows.repartition(max(1, partitions), key, "l", "r")
