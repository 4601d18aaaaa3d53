"""Time parsing, canonical time text and calendar features."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickwright.functions.cells import WHITESPACE, round_half_even

# What each strptime directive accepts.
DIRECTIVES = {
    "%Y": ("year", r"(?!0000)\d{4}"),
    "%y": ("short_year", r"\d{2}"),
    "%m": ("month", r"1[0-2]|0?[1-9]"),
    "%d": ("day", r"3[01]|[12]\d|0?[1-9]"),
    "%H": ("hour", r"2[0-3]|[01]?\d"),
    "%M": ("minute", r"[0-5]?\d"),
    "%S": ("second", r"[0-5]?\d"),
}

_MARK = "@"
_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
ISO_FORMAT = "%Y-%m-%d %H:%M:%S"


def _format_pattern(time_format: str) -> tuple[str, dict[str, int]]:
    """Regular expression for a strptime format and the group number of each field."""
    pattern, groups = "", {}
    for token in re.findall(r"%.|\s+|[^%\s]+", time_format):
        if token in DIRECTIVES:
            field, digits = DIRECTIVES[token]
            groups[field] = len(groups) + 1
            pattern += f"({digits})"
        elif token.startswith("%"):
            raise ValueError(f"time directive {token!r} is not supported")
        else:
            pattern += f"{_SPACE}+" if token.isspace() else re.escape(token)
    if not {"month", "day"} <= groups.keys() or not {"year", "short_year"} & groups.keys():
        raise ValueError(f"time format {time_format!r} needs year, month and day")
    return f"^{_MARK}{_SPACE}*{pattern}{_SPACE}*$", groups


def parse_time(c: Column, time_format: str) -> Column:
    """Text to ``timestamp_ntz``, NULL where it does not match the format or is no date.

    One pattern trims matching text, rewrites it to ISO order and takes away a leading mark;
    text that does not match keeps the mark and fails the cast.  The cast to a zone-less timestamp does
    not depend on the session time zone and returns NULL for dates such as 30 February.
    """
    pattern, groups = _format_pattern(time_format)
    marked = F.concat(F.lit(_MARK), c)

    def iso(year: str) -> Column:
        clock = ":".join(f"${groups[f]}" if f in groups else "0" for f in ("hour", "minute", "second"))
        return F.regexp_replace(marked, pattern, f"{year}-${groups['month']}-${groups['day']} {clock}")

    if "year" in groups:
        return iso(f"${groups['year']}").try_cast("timestamp_ntz")
    # Two-digit years: 69-99 belong to the 1900s, 00-68 to the 2000s.  Both centuries have their
    # leap years in the same places there, so the text is read once, as of the 2000s.
    read = iso(f"20${groups['short_year']}").try_cast("timestamp_ntz")
    return F.when(F.year(read) >= 2069, read - F.expr("INTERVAL '100' YEAR")).otherwise(read)


def canonical_time(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS``, blank for a missing time."""
    text = F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)
    return F.coalesce(F.replace(text, F.lit(" "), F.lit("T")), F.lit(""))


_EPOCH = "1970-01-01"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 on the zone-less clock, whatever the session time zone."""
    since = ts.cast("timestamp_ntz") - F.lit(_EPOCH).cast("timestamp_ntz")
    return (since.cast("decimal(24,6)") * F.lit(1_000_000)).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit(_EPOCH).cast("timestamp_ntz"))


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    amount = F.lit(seconds) if isinstance(seconds, int) else seconds
    return ts + F.make_dt_interval(secs=amount)


def calendar_features(ts: Column) -> dict[str, Column]:
    """Hour 0-23, weekday with Monday 0, month 1-12 and the weekend flag."""
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


def cyclic_features(ts: Column) -> dict[str, Column]:
    """Hour and weekday as points on a circle, so that 23 h is next to 0 h."""
    features = {}
    for name, part, period in (("hour", F.hour(ts), 24), ("day_of_week", F.weekday(ts), 7)):
        angle = part * F.lit(2 * math.pi) / F.lit(period)
        features[f"{name}_sin"] = round_half_even(F.sin(angle))
        features[f"{name}_cos"] = round_half_even(F.cos(angle))
    return features
