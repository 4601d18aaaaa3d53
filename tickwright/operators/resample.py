"""Averages over time windows and the chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.times import epoch_micros
from tickwright.operators.quantiles import exact_percentiles
from tickwright.operators.sequence import SERIES


def window_average(df: DataFrame, columns: Sequence[str], ts: str = "ts", width: str = "1 hour",
                   series: Sequence[str] = SERIES) -> DataFrame:
    """Mean of each column per series and window, with the number of rows.

    Works on a batch and, after ``withWatermark``, on a stream.  Rows are averaged before the
    shuffle, so one long series or one busy hour only sends partial sums.
    """
    grouped = df.groupBy(*series, F.window(ts, width).alias("__window")).agg(
        F.count("*").alias("rows"), *[F.avg(c).alias(c) for c in columns])
    return grouped.select(*series, F.col("__window.start").alias("window_start"), "rows", *columns)


def split_time(df: DataFrame, fraction: float, ts: str = "ts") -> int:
    """Cut-off in microseconds since 1970: the time at the given share of the rows."""
    times = df.select(epoch_micros(F.col(ts)).alias("micros"))
    cut = exact_percentiles(times, ["micros"], [fraction])["micros"][0]
    if cut is None:
        raise ValueError("no row has a time")
    return int(cut)


def is_train(cutoff: int, ts: str = "ts") -> Column:
    return epoch_micros(F.col(ts)) <= F.lit(cutoff)


def chronological_split(df: DataFrame, fraction: float = 0.8, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to the cut-off and rows after it; equal times always stay together."""
    cutoff = split_time(df, fraction, ts)
    return df.filter(is_train(cutoff, ts)), df.filter(~is_train(cutoff, ts))
