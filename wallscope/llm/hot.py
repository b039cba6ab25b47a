"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one in ``HOT`` rows are broadcast; there are fewer than ``HOT`` of them.
HOT = 1000


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with stored ``keys``, whose column ``size`` tells how many of ``total`` rows each has.

    The rows of hot keys, which are few by arithmetic as the sizes add up to ``total`` at most,
    don't move; all others are shuffled.
    """
    hot = keys.where(F.col(size) > total // HOT)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(keys, on))
