"""Flags that depend on row order: repeats, backward steps, gaps and runs of repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.functions.times import plus_seconds
from tickwright.operators.ordered import (
    CHUNK_BITS,
    LEVELS,
    SERIES_KEY,
    inherit_last,
    look_back,
    sorted_positions,
    with_chunk,
    with_series,
)

SERIES = ("source_dataset",)
FLAGS = (
    "flag_bad_timestamp_format",
    "flag_non_monotonic_time",
    "flag_duplicate_timestamp",
    "flag_time_gap_gt_expected",
    "flag_row_length_mismatch",
    "flag_non_numeric_in_numeric_field",
)


def previous_valid_time(df: DataFrame, ts: str = "ts", name: str = "prev_valid_time",
                        series: Sequence[str] = SERIES, ordinal: str = "ordinal",
                        bits: int = CHUNK_BITS, levels: int = LEVELS,
                        initial: DataFrame | None = None) -> DataFrame:
    """Time of the nearest earlier row that has one; rows without a time are passed over."""
    return look_back(df, {name: F.col(ts)}, series, ordinal, bits, levels, initial)


def flag_sequence(df: DataFrame, cadence: Column | int, ts: str = "ts",
                  series: Sequence[str] = SERIES, ordinal: str = "ordinal",
                  bits: int = CHUNK_BITS, levels: int = LEVELS,
                  initial: DataFrame | None = None, name: str = "prev_valid_time") -> DataFrame:
    """Add the four time flags; they compare each row with the previous valid time."""
    return time_flags(previous_valid_time(df, ts, name, series, ordinal, bits, levels, initial), cadence, ts, name)


def time_flags(seen: DataFrame, cadence: Column | int, ts: str = "ts", name: str = "prev_valid_time") -> DataFrame:
    """The flags of rows that know the previous valid time.

    Steps count in whole seconds: less than one second either way is a repeat.
    """
    now, before = F.col(ts), F.col(name)

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    return seen.withColumns({
        "flag_bad_timestamp_format": F.col(ts).isNull(),
        "flag_non_monotonic_time": holds(now <= plus_seconds(before, -1)),
        "flag_duplicate_timestamp": holds((now > plus_seconds(before, -1)) & (now < plus_seconds(before, 1))),
        "flag_time_gap_gt_expected": holds(now >= plus_seconds(before, cadence + 1)),
    })


def duplicate_run_groups(flagged: DataFrame, series: Sequence[str] = SERIES,
                         ordinal: str = "ordinal", dup: str = "flag_duplicate_timestamp",
                         bits: int = CHUNK_BITS, levels: int = LEVELS, initial: DataFrame | None = None) -> DataFrame:
    """One row per run of consecutive repeats: (series, start ordinal, run length).

    A run is the row before the repeats plus the repeats.  Rows are counted per chunk and
    run first, so a run that holds much of the series is only a few partial counts by the
    time the chunks are put together.  ``initial`` (series, run_start) says where the last row
    before these that is no repeat is; repeats that go on from it have that start.
    """
    repeat = F.col(dup)
    rows = with_chunk(with_series(flagged.select(*series, ordinal, dup), series), ordinal, bits)
    inside = W.partitionBy(SERIES_KEY, "__chunk").orderBy(ordinal)
    start_here = F.last(F.when(~repeat, F.col(ordinal)), ignorenulls=True).over(inside)
    parts = (
        rows.withColumn("__start", start_here).filter(repeat)
        .groupBy(SERIES_KEY, "__chunk", "__start").agg(F.count("*").alias("__repeats"))
    )
    ends = rows.groupBy(SERIES_KEY, "__chunk").agg(
        F.max(F.when(~repeat, F.col(ordinal))).alias("__open"))
    if initial is not None:
        before = with_series(initial, series).select(SERIES_KEY, F.lit(-1).cast("long").alias("__chunk"), F.col("run_start").alias("__open"))
        ends = ends.unionByName(before)
    inherited = inherit_last(ends, "__chunk", ["__open"], bits, levels)
    found = (
        parts.join(inherited, [SERIES_KEY, "__chunk"], "left")
        .withColumn("run_start", F.coalesce("__start", "__open"))
        .groupBy(SERIES_KEY, "run_start")
        .agg((F.sum("__repeats") + 1).alias("run_length"))
    )
    return found.select(*[F.col(SERIES_KEY)[c].alias(c) for c in series], "run_start", "run_length")


def duplicate_run_lengths(flagged: DataFrame, series: Sequence[str] = SERIES,
                          ordinal: str = "ordinal", bits: int = CHUNK_BITS, levels: int = LEVELS) -> DataFrame:
    """How many runs there are of each length."""
    groups = duplicate_run_groups(flagged, series, ordinal, bits=bits, levels=levels)
    return groups.groupBy(*series, "run_length").agg(F.count("*").alias("runs"))


def row_index(df: DataFrame, time: str = "time", ordinal: str = "ordinal",
              series: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Stable sort by time, then a row number from 0."""
    return sorted_positions(df, [time, ordinal], name, series)
