"""Min-max, standard and robust scaling with parameters fitted in Spark.

A fit gives one row per column.  Applying it is a projection with those few numbers as
literals, so scaling needs neither a join nor a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.config import ScalerConfig
from tickwright.functions.cells import round_half_even
from tickwright.functions.names import require_columns
from tickwright.operators.outliers import spread_table
from tickwright.operators.quantiles import exact_percentiles, numeric_column
from tickwright.operators.wide import per_column

EPSILON = sys.float_info.epsilon
PARAMS_SCHEMA = "column string, kind string, center double, scale double"

# Min-max ---------------------------------------------------------------------------------


def minmax_params(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max), one row per column, in column order."""
    return spread_table(df, columns).select("column", "min", "max")


def collect_ranges(params: DataFrame) -> dict[str, tuple[float, float]]:
    """The few fitted numbers; columns without values are left out."""
    return {r["column"]: (r["min"], r["max"]) for r in params.collect() if r["min"] is not None}


def minmax_scale(df: DataFrame, ranges: dict[str, tuple[float, float]], places: int = 6) -> DataFrame:
    """To [0, 1]; a column whose minimum equals its maximum becomes 0."""

    def scaled(c: Column, lo: float, hi: float) -> Column:
        if hi == lo:
            return F.when(c.isNotNull(), F.lit(0.0))
        return round_half_even((c - F.lit(lo)) / F.lit(hi - lo), places)

    return df.withColumns({c: scaled(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in ranges.items()})


def minmax_inverse(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(hi - lo) + F.lit(lo) for c, (lo, hi) in ranges.items()})


# Standard and robust ---------------------------------------------------------------------


def standard_params(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column: (column, n, mean, std, scale).

    ``scale`` is what values are divided by: 1 for a column that is constant, or whose
    deviation is rounding noise for values of that size, however many there are.
    """
    long = per_column(df, [
        F.struct(
            F.lit(c).alias("column"), F.count(numeric_column(c)).alias("n"),
            F.avg(numeric_column(c)).alias("mean"), F.stddev_pop(numeric_column(c)).alias("std"),
            (F.max(numeric_column(c)) - F.min(numeric_column(c))).alias("spread"))
        for c in columns
    ])
    constant = F.col("spread") <= F.lit(32 * EPSILON) * F.abs("mean")
    return long.withColumn("scale", F.when(constant, F.lit(1.0)).otherwise(F.col("std"))).drop("spread")


def robust_params(df: DataFrame, columns: Sequence[str], low: float = 10.0, high: float = 90.0,
                  **limits: int) -> DataFrame:
    """Median and percentile range per column: (column, median, low, high, scale)."""
    found = exact_percentiles(df, columns, [0.5, low / 100.0, high / 100.0], **limits)
    rows = []
    for c, (median, lo, hi) in found.items():
        spread = None if median is None else hi - lo
        scale = 1.0 if spread is not None and spread < 10 * EPSILON else spread
        rows.append((c, median, lo, hi, scale))
    return df.sparkSession.createDataFrame(
        rows, "column string, median double, low double, high double, scale double")


@dataclass(frozen=True)
class ScalerModel:
    """Fitted parameters and the roles of the columns they belong to."""

    config: ScalerConfig
    params: DataFrame  # PARAMS_SCHEMA, one row per scaled column

    def _numbers(self) -> dict[str, tuple[str, float, float]]:
        return {r["column"]: (r["kind"], r["center"], r["scale"]) for r in self.params.collect()}

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale pressures, flow and ratios; flags become 0/1 integers.

        A ratio column that is absent, or was absent when fitting, becomes 0.0.
        """
        fitted = self._numbers()
        require_columns(df, [c for c in self.config.standard_columns], "scaled")
        require_columns(df, self.config.flag_cols, "flag")
        scaled = {}
        for c in self.config.standard_columns:
            _, center, scale = fitted[c]
            scaled[c] = _shift(numeric_column(c), center, scale)
        for c in self.config.ratio_columns:
            if c in df.columns and c in fitted:
                _, center, scale = fitted[c]
                scaled[c] = _shift(numeric_column(c), center, scale)
            else:
                scaled[c] = F.lit(0.0)
        for c in self.config.flag_cols:
            scaled[c] = F.col(c).cast("int")
        return df.withColumns(scaled)

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.col(c) * F.lit(scale) + F.lit(center)
            for c, (_, center, scale) in self._numbers().items() if c in df.columns
        })

    def save(self, path: str) -> None:
        self.params.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: ScalerConfig) -> ScalerModel:
        return cls(config, spark.read.schema(PARAMS_SCHEMA).parquet(path))


def _shift(c: Column, center: float | None, scale: float | None) -> Column:
    return (c - F.lit(center).cast("double")) / F.lit(scale).cast("double")


def fit_scaler(df: DataFrame, config: ScalerConfig, low: float = 10.0, high: float = 90.0,
               **limits: int) -> ScalerModel:
    """Standard parameters for pressures and flow, robust ones for the ratios present."""
    require_columns(df, list(config.pressure_cols.values()), "pressure")
    require_columns(df, [config.inj_flow_col] if config.inj_flow_col else [], "flow")
    require_columns(df, config.flag_cols, "flag")
    rows = []
    if config.standard_columns:
        rows += [(r["column"], "standard", r["mean"], r["scale"])
                 for r in standard_params(df, config.standard_columns).collect()]
    ratios = [c for c in config.ratio_columns if c in df.columns]
    if ratios:
        rows += [(r["column"], "robust", r["median"], r["scale"])
                 for r in robust_params(df, ratios, low, high, **limits).collect()]
    return ScalerModel(config, df.sparkSession.createDataFrame(rows, PARAMS_SCHEMA))
