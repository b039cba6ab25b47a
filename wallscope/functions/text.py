"""Small text and number helpers that follow Python's printing rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of the characters that Python's str.strip() removes
# and its ``\s`` matches.
_WHITESPACE_CODES = [
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
]
WHITESPACE = "".join(chr(code) for code in _WHITESPACE_CODES)

# The same set as the inside of a Java character class. The property stands for
# all code points beyond Latin-1 at once: a long list of them is slow to rule out.
WHITESPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\p{IsWhite_Space}"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space; a scan of both ends, no regex."""
    return F.btrim(text, F.lit(WHITESPACE))


def percent(part: Column, whole: Column) -> Column:
    """Unrounded share in percent, 0 for an empty whole."""
    share = part.cast("double") / F.nullif(whole, F.lit(0)) * F.lit(100)
    return F.coalesce(share, F.lit(0.0))


def float_text(number: Column) -> Column:
    """An epoch-sized double printed like Python's ``repr(float)``.

    Spark prints ``1.6094592E9``; fixed-point text with the trailing zeros cut
    (one digit stays after the point) gives ``1609459200.0``.
    """
    fixed = number.try_cast("decimal(38,20)").cast("string")
    return F.regexp_replace(F.rtrim(fixed, F.lit("0")), r"\.$", ".0")


def usable_time(seconds: Column) -> Column:
    """Are these epoch seconds a date of the years 1 to 9999? NULL, NaN and infinite values are not."""
    return F.coalesce((seconds >= F.lit(-62135596800.0)) & (seconds < F.lit(253402300800.0)), F.lit(False))


def age_text(seconds: Column) -> Column:
    """Whole seconds as ``D day(s), H:MM:SS``; days are left out when zero."""
    days = F.floor(seconds / F.lit(86400))
    rest = seconds - days * F.lit(86400)
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / F.lit(3600)),
        F.floor(rest % F.lit(3600) / F.lit(60)),
        rest % F.lit(60),
    )
    unit = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))
