"""Sensor time-series preparation as plain Spark DataFrame jobs."""

from tickwright.config import ScalerConfig, SeriesConfig

__all__ = ["ScalerConfig", "SeriesConfig"]
