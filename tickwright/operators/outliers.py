"""Percentile bounds, winsorising, clipped-cell counts and zero-variance columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.cells import round_half_even
from tickwright.operators.quality import count_cells
from tickwright.operators.quantiles import exact_percentiles, numeric_column
from tickwright.operators.wide import per_column

Bounds = dict[str, tuple[float, float]]

ZERO_SPREAD = 1e-9


def round_columns(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """Round numeric cells; text that is no number stays as it is."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    rounded = {}
    for c in columns:
        if c in text:
            number = F.col(c).try_cast("double")
            rounded[c] = F.coalesce(round_half_even(number, places).cast("string"), F.col(c))
        else:
            rounded[c] = round_half_even(F.col(c).cast("double"), places)
    return df.withColumns(rounded)


def fit_bounds(df: DataFrame, columns: Sequence[str], low: float = 1.0, high: float = 99.0,
               **limits: int) -> Bounds:
    """Percentile bounds per column; columns without values are left out."""
    found = exact_percentiles(df, columns, [low / 100.0, high / 100.0], **limits)
    return {c: (b[0], b[1]) for c, b in found.items() if b[0] is not None}


def bounds_table(df: DataFrame, bounds: Bounds) -> DataFrame:
    rows = [(c, lo, hi) for c, (lo, hi) in bounds.items()]
    return df.sparkSession.createDataFrame(rows, "column string, lower double, upper double")


def clip(c: Column, low: float, high: float) -> Column:
    """Into [low, high]; a missing value stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def winsorize(df: DataFrame, bounds: Bounds, places: int = 6) -> DataFrame:
    return df.withColumns({
        c: round_half_even(clip(F.col(c).cast("double"), lo, hi), places) for c, (lo, hi) in bounds.items()
    })


def clip_counts(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Columns with values outside their bounds, most first, ties in column order."""
    outside = {c: (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in bounds.items()}
    counted = count_cells(df, outside, (), "column", "clipped")
    return counted.filter("clipped > 0").orderBy(F.desc("clipped"), "position").select("column", "clipped")


def total_clipped(df: DataFrame, bounds: Bounds) -> DataFrame:
    """One row: values outside their bounds over all columns."""
    return clip_counts(df, bounds).agg(F.coalesce(F.sum("clipped"), F.lit(0)).alias("clipped_cells"))


def spread_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: minimum, maximum, range and whether it is constant."""
    long = per_column(df, [
        F.struct(F.lit(c).alias("column"), F.min(numeric_column(c)).alias("min"), F.max(numeric_column(c)).alias("max"))
        for c in columns
    ])
    return long.withColumn("range", F.col("max") - F.col("min")).withColumn(
        "is_constant", F.coalesce(F.col("range") < ZERO_SPREAD, F.lit(True)))


def zero_variance_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    return [row["column"] for row in spread_table(df, columns).filter("is_constant").collect()]


def drop_zero_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*zero_variance_columns(df, columns))
