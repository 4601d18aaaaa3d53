"""Inputs that Spark derives from the given tables (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.config import ScalerConfig, SeriesConfig
from tickwright.functions.cells import any_of, is_non_numeric
from tickwright.functions.names import header_fallback, header_mapping, normalized_header
from tickwright.functions.times import parse_time
from tickwright.operators.sequence import flag_sequence
from tickwright.plans.clean import TIME
from tickwright.sources.delimited import MISMATCH, ORDINAL, repair_row_shape

CADENCE = 600
CONFIG = SeriesConfig("events", expected_gap_seconds=CADENCE, has_pump_state=True)
HEADERS = ["Time", "Net Flow", "Valve A (True/False)", "Triplex On/Off", "Injection EC"]
MAPPING = header_mapping(HEADERS, CONFIG)
CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SCALED = ScalerConfig(
    pressure_cols={"injection": "pressure", "monitor": "level"}, ratio_cols={"injection": "delta_P_delta_Q"},
    inj_flow_col="flow", flag_cols=("injecting", "producing"))
# Thresholds for the state flags on ``events``: user numbers serve as flow, values as pressure.
MIN_FLOW, MIN_PRESSURE = 10.0, 40.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of a dirty sensor log, one row per event, ordered by ``ordinal``."""
    events, i = table(spark, sf_dir, "events"), F.col("event_id")
    minute = F.concat(F.substring(F.col("ts").cast("string"), 1, 16), F.lit(":00"))
    hour_back = F.timestamp_add("HOUR", F.lit(-1), minute.cast("timestamp_ntz")).cast("string")
    short = F.concat(F.month("ts"), F.lit("/"), F.dayofmonth("ts"), F.lit("/"),
                     F.substring(F.year("ts").cast("string"), 3, 2), F.lit(" "),
                     F.hour("ts"), F.lit(":"), F.minute("ts"), F.lit(":"), F.second("ts"))
    return events.select(
        F.lit(CONFIG.name).alias("source_dataset"), i.alias("ordinal"),
        F.when(i % 97 == 13, "not-a-time").when(i % 101 == 7, hour_back).otherwise(minute).alias("time_raw"),
        short.alias("short_raw"),
        F.when(i % 89 == 5, "n/a").when(i % 83 == 3, "").otherwise(F.col("value").cast("string")).alias("flow_raw"),
        F.when(i % 5 == 0, "True").when(i % 5 == 1, " FALSE ").when(i % 5 == 2, "true").when(i % 5 == 3, "False")
        .when(i % 45 == 4, "open").otherwise("false").alias("valve_raw"),
        F.when(i % 61 == 9, "standby").when(i % 4 == 0, "On").when(i % 4 == 1, "off").when(i % 4 == 2, " OFF ")
        .otherwise("on").alias("pump_raw"),
        F.col("user_id").cast("string").alias("ec_raw"),
        F.when(i % 113 == 2, 3).when(i % 127 == 4, 6).otherwise(5).alias("n_cells"),
    )


def ragged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as an array of three, five or six cells."""
    cells = F.array("time_raw", "flow_raw", "valve_raw", "pump_raw", "ec_raw", F.lit("extra"))
    return raw_readings(spark, sf_dir).withColumn("cells", F.slice(cells, 1, F.col("n_cells")))


def parsed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_readings(spark, sf_dir)
    return raw.withColumn("ts", parse_time(F.col("time_raw"), CONFIG.time_format))


def flagged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six flags on the readings."""
    rows = parsed_readings(spark, sf_dir).withColumns({
        MISMATCH: F.col("n_cells") != len(HEADERS),
        "flag_non_numeric_in_numeric_field": any_of([is_non_numeric(F.col("flow_raw"))]),
    })
    return flag_sequence(rows, CADENCE)


def cleaned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ragged cells repaired and named as the file reader would name them."""
    repaired = repair_row_shape(ragged_cells(spark, sf_dir), "cells", len(HEADERS))
    names = ["time_raw" if f.role == "time" else f.clean for f in MAPPING]
    return repaired.select(
        "source_dataset", F.col("ordinal").alias(ORDINAL),
        *[F.trim(F.col("cells")[k]).alias(name) for k, name in enumerate(names)], MISMATCH)


def header_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names of many files, 32 each, made from the part names."""
    part, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    source = (
        # In each seventh file: x, x, x_2, x_2_2, which stay unique only after several rounds.
        F.when((F.floor(i / 32) % 7 == 0) & ((i % 32).isin(1, 2)), "x").when((F.floor(i / 32) % 7 == 0) & (i % 32 == 3), "x_2")
        .when((F.floor(i / 32) % 7 == 0) & (i % 32 == 4), "x_2_2")
        .when((i % 37 == 0) | (i % 64 == 0), "").when(i % 13 == 5, "%%%")
        .when(i % 11 == 3, F.concat(name, F.lit(" (True/False)")))
        .when(i % 7 == 2, F.concat(F.lit("  "), F.upper(name), F.lit(" Pressure ")))
        .when(i % 17 == 4, F.concat("p_type", F.lit("-TEC-"), size))
        .when(i % 19 == 6, F.concat(F.lit("PT "), size))
        .when(i % 23 == 1, F.concat(name, F.lit(" Flow (L/min)")))
        .when(i % 29 == 8, "Injection EC").when(i % 31 == 9, "Time").otherwise(name)
    )
    return part.select(F.floor(i / 32).cast("long").alias("file_id"), (i % 32).cast("int").alias("position"),
                       source.alias("source"))


def normalized_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = header_catalog(spark, sf_dir)
    source = F.col("source")
    return catalog.withColumn("clean", normalized_header(source, header_fallback(source, F.col("position"))))


def channels(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Four numeric channels of ``lineitem`` and one that is constant up to rounding noise."""
    noise = F.when(F.col("l_linenumber") % 2 == 0, 177.8).otherwise(177.8 + 3e-14)
    return table(spark, sf_dir, "lineitem").select(*keep, *CHANNELS, noise.alias("depth"))


def sensor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one sensor series: value as pressure, user number as flow."""
    return table(spark, sf_dir, "events").select(
        F.lit(CONFIG.name).alias("source_dataset"), F.col("event_id").alias("ordinal"), "ts",
        F.col("value").alias("pressure"), F.col("user_id").cast("double").alias("flow"))


__all__ = [name for name in globals() if not name.startswith("_")] + ["TIME"]
