"""Log lines to the fixed, typed log table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wallscope.functions import lines
from wallscope.functions.text import strip
from wallscope.schemas import PARSED


def _matched(raw: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Every input ``line`` with its ``joined`` fields.

    The pattern result goes through a one-element ``explode``: Catalyst would copy
    a plain projection's expression into every filter on it and run the pattern
    twice per line. A generator's output is computed once, in the same stage.
    """
    valid = raw.select(*keep, F.make_valid_utf8(F.col(column)).alias("line"))
    return valid.select(
        *keep, "line", F.explode(F.array(lines.joined_fields(F.col("line")))).alias("joined")
    )


def _typed(joined: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The typed columns of rows with ``joined`` fields."""
    fields = joined.select(*keep, lines.split_fields(F.col("joined")).alias("fields"))
    fields = fields.select(
        *keep, *[lines.field(F.col("fields"), i).alias(f[0]) for i, f in enumerate(lines.FIELDS)]
    )
    return fields.selectExpr(
        *[f"`{name}`" for name in keep],
        *[f"{lines.DERIVED.get(name, name)} AS {name}" for name in PARSED.fieldNames()],
    )


def parse_lines(
    raw: DataFrame, column: str = "value", keep: Sequence[str] = (), counts: Observation | None = None
) -> DataFrame:
    """Parse text lines; lines that are no log entry are dropped.

    One narrow stage. ``keep`` names further input columns to carry along. ``counts``
    observes ``lines``, ``parsed`` and ``rejected`` while the result is written or
    collected for the first time, so no second run of the pattern counts them.
    """
    matched = _matched(raw, column, keep)
    entry = F.col("joined") != F.col("line")
    if counts is not None:
        measures = {"lines": F.count("*"), "parsed": F.count_if(entry), "rejected": F.count_if(~entry)}
        matched = matched.observe(counts, *[m.alias(name) for name, m in measures.items()])
    return _typed(matched.where(entry), keep)


def parse_all(raw: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """A row per line by one run of the pattern: typed columns, NULL for a line that is no log
    entry, and ``rejected``, the stripped line if it is none, else NULL.
    """
    entry = F.col("joined") != F.col("line")
    rows = _matched(raw, column, keep).select(
        *keep,
        F.when(entry, F.col("joined")).alias("joined"),
        F.when(~entry, strip(F.col("line"))).alias("rejected"),
    )
    return _typed(rows, [*keep, "rejected"])


def rejected_lines(raw: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The stripped lines that ``parse_lines`` drops; blank lines included."""
    rejects = _matched(raw, column, keep).where(F.col("joined") == F.col("line"))
    return rejects.select(*keep, strip(F.col("line")).alias("line"))
