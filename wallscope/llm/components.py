"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, of all nodes in ``edges`` (a, b bigint).

    Rounds of contraction: every node hooks to its smallest neighbour, two steps of pointer
    jumping shorten the way, then links are rewritten to what their ends hooked to. The
    number of rounds grows with the logarithm of the longest path. Every table of a round is
    stored in the shared folder, so lost executors cost a re-read only.
    """
    links = materialize(edges.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
        hook = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        for _ in range(2):
            onward = hook.select(F.col("x").alias("m"), F.col("m").alias("next"))
            hook = materialize(hook.join(onward, "m").select("x", F.col("next").alias("m")), "hooks")
        if labels is None:
            labels = hook.select(F.col("x").alias("node"), F.col("m").alias("component"))
        else:
            moved = hook.select(F.col("x").alias("component"), F.col("m").alias("lower"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
            labels = materialize(labels, "labels")
        first, second = hook.toDF("a", "p"), hook.toDF("b", "q")
        links = links.join(first, "a").join(second, "b").where("p <> q")
        links = materialize(links.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
