"""Age, staleness and description of feed snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscope.functions.text import age_text, usable_time

# Fixed value: a snapshot is refreshed after a day.
REFRESH_INTERVAL = 86400


def staleness(meta: DataFrame, now: float, interval: float = REFRESH_INTERVAL) -> DataFrame:
    """``needs_refresh`` per source; unusable metadata always needs it."""
    usable = usable_time(F.col("timestamp"))
    age = F.when(usable, F.lit(float(now)) - F.col("timestamp"))
    return meta.select(
        "source",
        usable.alias("usable"),
        age.alias("age_seconds"),
        F.coalesce(age > F.lit(float(interval)), F.lit(True)).alias("needs_refresh"),
    )


def feed_info(meta: DataFrame, now: float, configured: Mapping[str, str] | None = None) -> DataFrame:
    """Entry count, update time, URL and age of every source with usable metadata."""
    usable = usable_time(F.col("timestamp"))
    # The condition stands in each expression: a filter alone does not keep bad values from a cast.
    seconds = F.when(usable, F.col("timestamp"))
    age = (F.lit(float(now)) - seconds).cast("bigint")
    urls = F.create_map(*[F.lit(text) for pair in (configured or {"": ""}).items() for text in pair])
    return meta.where(usable).select(
        "source",
        "count",
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss").alias("updated"),
        F.coalesce("url", F.try_element_at(urls, F.col("source")), F.lit("Unknown")).alias("url"),
        age.alias("age_seconds"),
        age_text(age).alias("age"),
    )
