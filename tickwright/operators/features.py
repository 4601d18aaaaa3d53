"""Engineered columns: calendar, cyclic, change ratio and operating state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.functions.cells import round_half_even
from tickwright.functions.times import calendar_features, cyclic_features
from tickwright.operators.ordered import CHUNK_BITS, LEVELS, previous_row
from tickwright.operators.sequence import SERIES


def add_time_features(df: DataFrame, ts: str = "ts", calendar: bool = True, cyclic: bool = True) -> DataFrame:
    features: dict[str, Column] = {}
    if calendar:
        features |= calendar_features(F.col(ts))
    if cyclic:
        features |= cyclic_features(F.col(ts))
    return df.withColumns(features)


def delta_ratio(df: DataFrame, pressure: str, flow: str, name: str = "delta_P_delta_Q",
                series: Sequence[str] = SERIES, ordinal: str = "ordinal",
                no_flow_change: float | None = 0.0, places: int | None = 2,
                bits: int = CHUNK_BITS, levels: int = LEVELS) -> DataFrame:
    """Change in pressure over change in flow from one row to the next.

    The first row is 0.  Where the flow did not change, ``no_flow_change`` is used; no rule
    for that case is published, so it is a parameter.
    """
    stepped = previous_row(df, {"__p": pressure, "__q": flow}, series, ordinal, bits, levels)
    change_p, change_q = F.col(pressure) - F.col("__p"), F.col(flow) - F.col("__q")
    ratio = F.when(change_q == 0, F.lit(no_flow_change).cast("double")).otherwise(
        F.try_divide(change_p.cast("double"), change_q.cast("double")))
    ratio = F.coalesce(ratio, F.lit(0.0))
    if places is not None:
        ratio = round_half_even(ratio, places)
    return stepped.withColumn(name, ratio).drop("__p", "__q")


def add_state_flags(df: DataFrame, injection_flow: str, injection_pressure: str,
                    min_flow: float, min_pressure: float, injecting: str = "tc_injecting",
                    producing: str = "tc_producing") -> DataFrame:
    """0/1 flags: injecting when flow and pressure are both above their thresholds, producing
    when pressure is below its threshold while flow is still above it.

    The rule behind the published flags is not stated; thresholds are the caller's.
    """
    flowing = F.col(injection_flow) > min_flow
    pressed = F.col(injection_pressure) > min_pressure
    return df.withColumns({
        injecting: F.coalesce(flowing & pressed, F.lit(False)).cast("int"),
        producing: F.coalesce(flowing & ~pressed, F.lit(False)).cast("int"),
    })
