"""Variant flow: basic, clipped, normalised and feature tables from one typed table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.functions.names import ml_names, named
from tickwright.functions.times import ISO_FORMAT, parse_time
from tickwright.operators.features import add_time_features
from tickwright.operators.ordered import in_files, sorted_positions
from tickwright.operators.outliers import Bounds, fit_bounds, round_columns, winsorize, zero_variance_columns
from tickwright.operators.scaling import collect_ranges, minmax_params, minmax_scale
from tickwright.session import stage_table
from tickwright.sources.sinks import write_csv, write_params

_FILE = "_sorted_file"


@dataclass(frozen=True)
class Variants:
    """The four tables, the bounds and the min-max parameters (column, min, max).

    ``placed`` has the tables with the number of the sorted file that each row is in.
    """

    basic: DataFrame
    clipped: DataFrame
    features: DataFrame
    normalized: DataFrame
    bounds: Bounds
    params: DataFrame
    placed: dict[str, DataFrame]


def typed_numbers(df: DataFrame, columns: Sequence[str], on_error: str = "fail") -> DataFrame:
    """Text to double.  A bad or blank cell fails the job; ``on_error="null"`` makes it NULL."""
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    typed = {c: named(c).cast("double") if on_error == "fail" else named(c).try_cast("double")
             for c in columns}
    return df.withColumns(typed)


def basic_variant(df: DataFrame, time: str = "Time", ordinal: str = "_ordinal",
                  on_error: str = "fail", file: str | None = None) -> tuple[DataFrame, list[str]]:
    """Sorted by time with a row index, ML names, constant columns dropped, six places.

    Everything but the time is numeric.  Returns the table and its numeric columns.  ``file``
    names a column for the number of the sorted file.
    """
    names = [c for c in df.columns if c != ordinal]
    numeric = [c for c in names if c != time]
    typed = typed_numbers(df, numeric, on_error)
    constant = set(zero_variance_columns(typed, numeric))
    clean = dict(zip(names, ml_names(names), strict=True))
    kept = [c for c in names if c not in constant]
    numbers = [clean[c] for c in kept if c != time]
    renamed = typed.select(F.col(ordinal).alias("_order"), *[named(c).alias(clean[c]) for c in kept])
    placed = sorted_positions(round_columns(renamed, numbers), [clean[time], "_order"], "row_index", file=file)
    return placed.drop("_order"), numbers


def build_variants(df: DataFrame, time: str = "Time", ordinal: str = "_ordinal", on_error: str = "fail",
                   low: float = 1.0, high: float = 99.0, time_format: str = ISO_FORMAT) -> Variants:
    """All variants.  The sorted basic table is staged by the sort itself; the others are
    projections of it with a few fitted numbers."""
    basic, numbers = basic_variant(df, time, ordinal, on_error, _FILE)
    bounds = fit_bounds(basic, numbers, low, high)
    clipped = winsorize(basic, bounds)
    params = minmax_params(clipped, numbers)
    normalized = minmax_scale(clipped, collect_ranges(params))
    time_name = ml_names([time])[0]
    timed = basic.withColumn("_ts", parse_time(F.col(time_name).cast("string"), time_format))
    features = add_time_features(timed, "_ts").drop("_ts")
    placed = {"basic": basic, "clipped": clipped, "features": features, "normalized": normalized}
    return Variants(**{name: table.drop(_FILE) for name, table in placed.items()}, bounds=bounds, params=params, placed=placed)


def write_variants(variants: Variants, output: str) -> dict[str, tuple[int, int]]:
    """Five CSV outputs; returns rows and columns of the tables.

    Rows are in the order of the row index, file after file: each sorted file is one task's,
    and no table is sorted by range again.
    """
    sizes = {}
    for name, table in variants.placed.items():
        sizes[name] = write_csv(in_files(table, "row_index", _FILE).drop(_FILE), f"{output}/{name}")
    write_params(stage_table(variants.params, "params"), f"{output}/normalization_params")
    return sizes
