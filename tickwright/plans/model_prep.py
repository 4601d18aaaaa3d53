"""Modelling flow: QC filter, reduced columns, engineered features, fitted scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tickwright.config import ScalerConfig
from tickwright.operators.features import add_state_flags, delta_ratio
from tickwright.operators.quality import qc_filter
from tickwright.operators.scaling import ScalerModel, fit_scaler
from tickwright.session import stage_table
from tickwright.sources.tables import keep_columns


def prepare_for_model(df: DataFrame, config: ScalerConfig, keep: Sequence[str], pressure: str, flow: str,
                      min_flow: float, min_pressure: float, ordinal: str = "ordinal",
                      series: Sequence[str] = ("source_dataset",),
                      ratio_places: int | None = 2, output: str | None = None) -> tuple[DataFrame, ScalerModel]:
    """Drop flagged rows, keep the named columns, add features, scale.

    Features come after the filter, so a change ratio never spans a dropped repeat.  The
    engineered table is staged, since fitting reads it several times.  ``df`` can be what the
    cleaning flow wrote (ordinal ``row_order``); with ``output`` the scaled rows are written
    there as parquet and read from there.
    """
    reduced = qc_filter(keep_columns(df, keep))
    ratio = config.ratio_columns[0] if config.ratio_columns else "delta_P_delta_Q"
    engineered = delta_ratio(reduced, pressure, flow, ratio, series, ordinal, places=ratio_places)
    injecting, producing = (list(config.flag_cols) + ["tc_injecting", "tc_producing"])[:2]
    engineered = add_state_flags(engineered, flow, pressure, min_flow, min_pressure, injecting, producing)
    engineered = stage_table(engineered, "engineered")
    model = fit_scaler(engineered, config)
    scaled = model.transform(engineered)
    if output is not None:
        scaled.write.mode("overwrite").parquet(output)
        scaled = df.sparkSession.read.schema(scaled.schema).parquet(output)
    return scaled, model
