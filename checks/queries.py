"""One query per operator; each takes (spark, folder of parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.inputs import (
    CADENCE, CHANNELS, CONFIG, HEADERS, MAPPING, MIN_FLOW, MIN_PRESSURE, SCALED, channels, cleaned_cells,
    flagged_readings, header_catalog, normalized_catalog, parsed_readings, ragged_cells, raw_readings,
    sensor_series, table,
)
from tickwright.config import ScalerConfig, SeriesConfig
from tickwright.functions import cells, names, times
from tickwright.operators import features, ordered, outliers, profile, quality, resample, scaling, sequence
from tickwright.plans import clean, model_prep, variants
from tickwright.session import stage_path, stage_table
from tickwright.sources import delimited, tables
from tickwright.streaming.averages import start_to_parquet, stream_window_average
from tickwright.streaming.flags import StreamFlagger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEQUENCE_FLAGS = list(sequence.FLAGS[:4])


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def round6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


# Sources ---------------------------------------------------------------------------------


@query
def multi_dataset_union(spark, sf):
    """Two series with their own cadence, stacked and flagged together."""
    events = parsed_readings(spark, sf).select("ordinal", "ts", F.lit(CADENCE).alias("cadence"), "flow_raw")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.lit(86400).alias("cadence"))
    stacked = tables.stack_series({"events": events, "orders": orders})
    flagged = sequence.flag_sequence(stacked, F.col("cadence"))
    return flagged.select("source_dataset", "ordinal", "ts", "flow_raw", *SEQUENCE_FLAGS)


@query
def sample_first_n(spark, sf):
    rows = raw_readings(spark, sf).select("ordinal", "time_raw", "flow_raw")
    return delimited.first_rows(rows, 1000, "ordinal")


@query
def delimited_scan(spark, sf):
    """The ragged readings written as text lines, then read and cleaned as a file."""
    cell = F.transform("cells", lambda c: F.when(c.contains(" "), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c))
    lines = ragged_cells(spark, sf).orderBy("ordinal").select(F.array_join(cell, ",").alias("value"))
    path = stage_path(spark, "lines")
    lines.write.text(path)
    rows, mapping = delimited.read_series(spark, CONFIG, path, headers=HEADERS)
    return clean.audit_table(clean.flag_rows(rows, mapping, CONFIG), mapping)


@query
def typed_load(spark, sf):
    """Text cells typed by their values: float with missing cells, text, integer."""
    raw = raw_readings(spark, sf).select(F.col("ordinal").cast("string").alias("ordinal"), "flow_raw", "valve_raw", "ec_raw")
    return tables.infer_types(raw)


# Headers ---------------------------------------------------------------------------------


@query
def header_normalize(spark, sf):
    return normalized_catalog(spark, sf)


@query
def header_dedupe(spark, sf):
    return names.number_repeats(normalized_catalog(spark, sf), "file_id", "position", "clean")


@query
def header_roles(spark, sf):
    role = names.header_role(F.col("source"), F.col("clean"))
    return normalized_catalog(spark, sf).withColumn("role", role)


@query
def ml_name(spark, sf):
    named = header_catalog(spark, sf).withColumn("ml_name", names.ml_name_column(F.col("source")))
    return names.number_repeats(named, "file_id", "position", "ml_name")


@query
def column_definition(spark, sf):
    return names.definition_column(header_catalog(spark, sf), "source")


@query
def column_unit(spark, sf):
    return header_catalog(spark, sf).withColumn("unit", names.unit_column(F.col("source")))


# Cells -----------------------------------------------------------------------------------


@query
def row_shape_repair(spark, sf):
    repaired = delimited.repair_row_shape(ragged_cells(spark, sf), "cells", len(HEADERS))
    return repaired.select("ordinal", "n_cells", delimited.MISMATCH,
                           *[F.col("cells")[k].alias(f"cell_{k + 1}") for k in range(len(HEADERS))])


@query
def safe_parse_time(spark, sf):
    return raw_readings(spark, sf).select(
        "ordinal", times.parse_time(F.col("time_raw"), CONFIG.time_format).alias("ts"),
        times.parse_time(F.col("short_raw"), "%m/%d/%y %H:%M:%S").alias("short_ts"))


@query
def canonical_time(spark, sf):
    return parsed_readings(spark, sf).select("ordinal", times.canonical_time(F.col("ts")).alias("time"))


@query
def boolean_normalize(spark, sf):
    return raw_readings(spark, sf).select("ordinal", cells.normalize_word(F.col("valve_raw")).alias("valve"))


@query
def boolean_encode(spark, sf):
    return raw_readings(spark, sf).select("ordinal", cells.encode_boolean(F.col("valve_raw")).alias("valve"))


@query
def state_encode(spark, sf):
    pump = F.col("pump_raw")
    return raw_readings(spark, sf).select(
        "ordinal", cells.normalize_word(pump).alias("pump"), cells.encode_state(pump).alias("pump_on"))


@query
def numeric_check(spark, sf):
    flag = cells.any_of([cells.is_non_numeric(F.col(c)) for c in ("flow_raw", "ec_raw")])
    return raw_readings(spark, sf).select("ordinal", flag.alias("flag_non_numeric_in_numeric_field"))


@query
def numeric_coerce(spark, sf):
    return raw_readings(spark, sf).select("ordinal", cells.as_number(F.col("flow_raw")).alias("flow"))


@query
def datetime_detect(spark, sf):
    """Mostly parsable text becomes a time; text below the threshold stays text."""
    raw = raw_readings(spark, sf)
    sparse = F.when(F.col("ordinal") % 3 == 0, F.lit("pending")).otherwise(F.col("time_raw"))
    return profile.detect_datetimes(raw.select("ordinal", "time_raw", sparse.alias("sparse_time"), "flow_raw"))


# Order-dependent flags -------------------------------------------------------------------


@query
def prev_valid_time(spark, sf):
    seen = sequence.previous_valid_time(parsed_readings(spark, sf))
    return seen.select("ordinal", "ts", "prev_valid_time")


def _flag(name: str) -> Query:
    return lambda spark, sf: flagged_readings(spark, sf).select("ordinal", name)


QUERIES["flag_bad_timestamp"] = _flag("flag_bad_timestamp_format")
QUERIES["flag_non_monotonic"] = _flag("flag_non_monotonic_time")
QUERIES["flag_duplicate"] = _flag("flag_duplicate_timestamp")
QUERIES["flag_gap"] = _flag("flag_time_gap_gt_expected")
QUERIES["flag_row_length"] = _flag("flag_row_length_mismatch")


@query
def duplicate_runs(spark, sf):
    return sequence.duplicate_run_lengths(flagged_readings(spark, sf))


@query
def row_index(spark, sf):
    rows = parsed_readings(spark, sf).select("ordinal", F.col("ts").alias("time"))
    return sequence.row_index(rows)


@query
def row_index_per_series(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("event_id").alias("ordinal"), F.col("ts").alias("time"))
    return sequence.row_index(rows, series=["event_type"])


@query
def row_index_null_series(spark, sf):
    """A third of the events have no series name; they are one series."""
    series = F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type")
    rows = table(spark, sf, "events").select(series, F.col("event_id").alias("ordinal"), F.col("ts").alias("time"))
    return sequence.row_index(rows, series=["event_type"])


@query
def delta_ratio(spark, sf):
    changed = features.delta_ratio(sensor_series(spark, sf), "pressure", "flow", places=9)
    return changed.select("ordinal", "pressure", "flow", "delta_P_delta_Q")


@query
def state_flags(spark, sf):
    return features.add_state_flags(sensor_series(spark, sf), "flow", "pressure", MIN_FLOW, MIN_PRESSURE).select(
        "ordinal", "tc_injecting", "tc_producing")


# QA --------------------------------------------------------------------------------------


@query
def qa_counts(spark, sf):
    return quality.qa_counts(flagged_readings(spark, sf))


@query
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(parsed_readings(spark, sf))


@query
def duplicate_examples(spark, sf):
    return quality.duplicate_examples(quality.duplicate_keys(parsed_readings(spark, sf)))


@query
def offending_columns(spark, sf):
    return quality.offending_columns(raw_readings(spark, sf), ["flow_raw", "ec_raw", "valve_raw"])


@query
def qa_summary(spark, sf):
    """The nested summary with its lists and maps printed as text."""
    flagged = stage_table(flagged_readings(spark, sf).select(
        "source_dataset", "ordinal", "ts", "flow_raw", "ec_raw", *sequence.FLAGS), "flagged")
    return _qa_shown(quality.qa_summary(flagged, ["flow_raw", "ec_raw"]))


def _qa_shown(summary):
    def listed(entries, key, value):
        shown = F.transform(entries, lambda e: F.concat(e[key], F.lit("="), e[value].cast("string")))
        return F.array_join(F.array_sort(shown), ", ")

    return summary.withColumns({
        "duplicate_timestamp_examples": listed(F.col("duplicate_timestamp_examples"), "time", "count"),
        "consecutive_duplicate_run_lengths": listed(F.map_entries("consecutive_duplicate_run_lengths"), "key", "value"),
        "offending_numeric_columns": listed(F.map_entries("offending_numeric_columns"), "key", "value"),
    })


@query
def qa_summary_null_series(spark, sf):
    """The summary by event type, of which every third event has none."""
    typed = table(spark, sf, "events").select(
        F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"))
    rows = parsed_readings(spark, sf).join(typed, "ordinal").withColumns({
        "source_dataset": F.col("kind"), "flag_row_length_mismatch": F.col("n_cells") != 5,
        "flag_non_numeric_in_numeric_field": cells.is_non_numeric(F.col("flow_raw"))})
    flagged = stage_table(sequence.flag_sequence(rows, CADENCE).select(
        "source_dataset", "ordinal", "ts", "flow_raw", "ec_raw", *sequence.FLAGS), "flagged")
    return _qa_shown(quality.qa_summary(flagged, ["flow_raw", "ec_raw"]))


@query
def audit_table(spark, sf):
    flagged = clean.flag_rows(cleaned_cells(spark, sf), MAPPING, CONFIG)
    return clean.audit_table(flagged, MAPPING)


@query
def ml_ready_table(spark, sf):
    flagged = clean.flag_rows(cleaned_cells(spark, sf), MAPPING, CONFIG)
    return clean.ml_ready_table(flagged, MAPPING)


@query
def qc_filter(spark, sf):
    return quality.qc_filter(flagged_readings(spark, sf)).select("ordinal", "time_raw", "flow_raw")


@query
def blank_counts(spark, sf):
    return profile.blank_counts(raw_readings(spark, sf), ["time_raw", "flow_raw", "valve_raw"])


# Outliers and scaling --------------------------------------------------------------------


@query
def reduced_projection(spark, sf):
    return tables.keep_columns(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])


@query
def round_columns(spark, sf):
    scaled = channels(spark, sf, "l_orderkey").select(
        "l_orderkey", *[(F.col(c) / 7).alias(c) for c in CHANNELS])
    return outliers.round_columns(scaled, CHANNELS)


@query
def zero_variance_report(spark, sf):
    report = outliers.spread_table(channels(spark, sf), [*CHANNELS, "depth"])
    return report.select("column", *round6("min", "max", "range"), "is_constant")


def _bounds(spark, sf, **limits):
    data = channels(spark, sf)
    fitted = outliers.bounds_table(data, outliers.fit_bounds(data, CHANNELS, **limits))
    return fitted.select("column", *round6("lower", "upper"))


@query
def percentile_bounds(spark, sf):
    return _bounds(spark, sf)


@query
def percentile_bounds_narrowed(spark, sf):
    """The same bounds by narrowing, as for tables that no task could hold."""
    return _bounds(spark, sf, max_open_values=500, accuracy=200)


@query
def winsorize(spark, sf):
    data = channels(spark, sf, "l_orderkey")
    return outliers.winsorize(data, outliers.fit_bounds(data, CHANNELS)).select("l_orderkey", *CHANNELS)


@query
def clip_counts(spark, sf):
    data = channels(spark, sf)
    return outliers.clip_counts(data, outliers.fit_bounds(data, CHANNELS))


def _clipped(spark, sf):
    data = channels(spark, sf, "l_orderkey")
    return outliers.winsorize(data, outliers.fit_bounds(data, CHANNELS))


@query
def minmax_params(spark, sf):
    return scaling.minmax_params(_clipped(spark, sf), CHANNELS)


@query
def minmax_scale(spark, sf):
    clipped = _clipped(spark, sf).withColumn("depth", F.lit(177.8))
    ranges = scaling.collect_ranges(scaling.minmax_params(clipped, [*CHANNELS, "depth"]))
    return scaling.minmax_scale(clipped, ranges)


@query
def minmax_inverse(spark, sf):
    """Scaled without rounding and turned back: the clipped values again."""
    clipped = _clipped(spark, sf)
    ranges = scaling.collect_ranges(scaling.minmax_params(clipped, CHANNELS))
    back = scaling.minmax_inverse(scaling.minmax_scale(clipped, ranges, places=15), ranges)
    return back.select("l_orderkey", *round6(*CHANNELS))


@query
def standard_params(spark, sf):
    fitted = scaling.standard_params(channels(spark, sf), [*CHANNELS, "depth"])
    return fitted.select("column", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "scale")])


_PLAIN = ScalerConfig(pressure_cols={"a": "l_extendedprice", "b": "depth"}, inj_flow_col="l_quantity")


@query
def standard_scale(spark, sf):
    data = channels(spark, sf, "l_orderkey").withColumn("depth", F.lit(177.8))
    scaled = scaling.fit_scaler(data, _PLAIN).transform(data)
    return scaled.select("l_orderkey", *round6("l_extendedprice", "depth", "l_quantity"))


@query
def robust_params(spark, sf):
    fitted = scaling.robust_params(channels(spark, sf), CHANNELS)
    return fitted.select("column", *round6("median", "low", "high", "scale"))


@query
def robust_scale(spark, sf):
    data = channels(spark, sf, "l_orderkey")
    config = ScalerConfig(pressure_cols={}, ratio_cols={"a": "l_extendedprice", "b": "l_tax"})
    return scaling.fit_scaler(data, config).transform(data).select("l_orderkey", *round6("l_extendedprice", "l_tax"))


@query
def ratio_zero_impute(spark, sf):
    """Fitted without the ratio columns: one is present later, one is not."""
    data = channels(spark, sf, "l_orderkey")
    config = ScalerConfig(pressure_cols={"a": "l_extendedprice"}, ratio_cols={"a": "l_tax", "b": "absent_ratio"})
    model = scaling.fit_scaler(data.drop("l_tax"), config)
    return model.transform(data).select("l_orderkey", *round6("l_extendedprice"), "l_tax", "absent_ratio")


# Features and time -----------------------------------------------------------------------


@query
def time_features(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return features.add_time_features(rows, cyclic=False).drop("ts")


@query
def cyclic_features(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return features.add_time_features(rows, calendar=False).drop("ts")


@query
def hourly_average(spark, sf):
    hourly = resample.window_average(sensor_series(spark, sf), ["pressure", "flow"])
    return hourly.select("source_dataset", "window_start", "rows", *round6("pressure", "flow"))


@query
def chronological_split(spark, sf):
    series = sensor_series(spark, sf)
    cutoff = resample.split_time(series, 0.8)
    return series.select("ordinal", resample.is_train(cutoff).alias("is_train"))


# Profiles --------------------------------------------------------------------------------


@query
def numeric_profile(spark, sf):
    gaps = F.when(F.col("l_tax") > 0.01, F.col("l_tax"))
    data = channels(spark, sf).withColumn("l_tax", gaps).withColumn("nothing", F.lit(None).cast("double"))
    found = profile.numeric_profile(data, [*CHANNELS, "depth", "nothing"])
    return found.select("column", "position", *[F.round(c, 9).alias(c) for c in ("minimum", "maximum", "mean", "median", "range", "std_dev")],
                        "count", "missing_count", "missing_percent", "unique_count")


@query
def datetime_profile(spark, sf):
    found = profile.datetime_profile(parsed_readings(spark, sf), ["ts"])
    seconds = (F.timestamp_diff("SECOND", F.col("minimum"), F.col("maximum"))).alias("range_seconds")
    return found.select("column", "minimum", "maximum", F.date_trunc("second", "mean").cast("timestamp_ntz").alias("mean"),
                        "median", seconds, "count", "missing_count", "missing_percent", "unique_count")


@query
def text_profile(spark, sf):
    raw = raw_readings(spark, sf).withColumn("flow_raw", F.nullif("flow_raw", F.lit("")))
    return profile.text_profile(raw, ["valve_raw", "flow_raw", "pump_raw"], "ordinal").drop("position")


@query
def column_profile(spark, sf):
    """The fifteen dictionary fields of every column of ``orders``; numbers are shown with six
    places and times in seconds, since the last digits of a mean depend on the order of adding."""
    found = profile.data_dictionary(table(spark, sf, "orders"), "o_orderkey")
    numbers = ("Minimum", "Maximum", "Mean", "Median", "Range", "Std Dev")
    return found.withColumns({
        c: F.coalesce(F.round(F.col(c).try_cast("double"), 6).cast("decimal(38,6)").cast("string"),
                      F.regexp_replace(c, r"(:\d\d)\.\d+$", "$1")) for c in numbers})


@query
def dictionary_fields(spark, sf):
    """The dictionary document of ``orders``, one row per entry of its field list."""
    document = profile.dictionary_document(table(spark, sf, "orders"), "o_orderkey", "orders", "Orders table")
    fields = document.select("dataset", "description", F.posexplode("fields").alias("at", "f"))
    return fields.select("dataset", "description", "at", *[
        F.col(f"f.{c}").alias(c) for c in ("term", "definition", "type", "count", "unique_count", "example_values")
    ], *[F.round(f"f.{c}", 6).alias(c) for c in ("minimum", "maximum", "mean", "median", "std_dev")])


@query
def dataset_summary(spark, sf):
    return profile.dataset_summary(table(spark, sf, "orders"), "orders.parquet")


@query
def value_frequency(spark, sf):
    return profile.value_frequency(table(spark, sf, "events"), "value", 0)


@query
def sign_counts(spark, sf):
    shifted = table(spark, sf, "events").select((F.col("value") - 50).alias("value"), F.col("user_id").cast("double").alias("user_id"))
    return profile.sign_counts(shifted, ["value", "user_id"])


@query
def distinct_sample(spark, sf):
    return profile.distinct_sample(table(spark, sf, "lineitem"), "l_extendedprice")


# Flows -----------------------------------------------------------------------------------


def _sensor_file(spark, sf):
    """A typed sensor file: time as text, two channels, one constant channel."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("_ordinal"), F.substring(F.col("ts").cast("string"), 1, 19).alias("Time"),
        (F.col("value") / 7).cast("string").alias("TL Interval Pressure"),
        F.col("user_id").cast("string").alias("Net-Flow (L/min)"), F.lit("177.8").alias("TU Packer Center Depth"))


@query
def variant_basic(spark, sf):
    return variants.basic_variant(_sensor_file(spark, sf))[0]


@query
def variant_normalized(spark, sf):
    return variants.build_variants(_sensor_file(spark, sf)).normalized


@query
def variant_features(spark, sf):
    return variants.build_variants(_sensor_file(spark, sf)).features


@query
def scaled_for_model(spark, sf):
    """QC filter, reduced columns, change ratio, state flags, then scaling."""
    flagged = flagged_readings(spark, sf).select(
        "source_dataset", "ordinal", "time_raw", cells.as_number(F.col("ec_raw")).alias("flow"),
        F.coalesce(cells.as_number(F.col("flow_raw")), F.lit(0.0)).alias("pressure"),
        (F.col("ordinal") % 1000).cast("double").alias("level"),
        "flag_duplicate_timestamp", "flag_time_gap_gt_expected")
    scaled, _ = model_prep.prepare_for_model(
        stage_table(flagged, "flagged"), SCALED, flagged.columns, "pressure", "flow", MIN_FLOW, MIN_PRESSURE,
        ratio_places=9)
    return scaled.select("ordinal", *round6("pressure", "level", "flow", "delta_P_delta_Q"), "injecting", "producing")


def _as_file(spark, rows, value="value", label="file"):
    """Lines written in the order of their ordinal; rows are sorted before lines are made."""
    path = stage_path(spark, label)
    rows.orderBy("ordinal").select((F.col(value) if isinstance(value, str) else value).alias("value")).write.text(path)
    return path


WIDE = 67


@query
def wide_clean(spark, sf):
    """A log as wide as real ones, from text to the ML-ready table; the audit cells as a digest."""
    i = F.col("ordinal")
    channels_ = [
        F.when(i % (97 + k) == k, "n/a").when(i % (89 + k) == 3, "").otherwise((i * (k + 1) % 1000).cast("string")).alias(f"c{k}")
        for k in range(WIDE)
    ]
    path = _as_file(spark, raw_readings(spark, sf), F.concat_ws(",", "time_raw", *channels_), "wide")
    config = SeriesConfig("wide", expected_gap_seconds=CADENCE)
    rows, mapping = delimited.read_series(
        spark, config, path, headers=["Time", *[f"Channel {k}" for k in range(WIDE)]])
    flagged = clean.flag_rows(rows, mapping, config)
    # The digest is added to the row it is of, so that the wide rows are not joined with themselves.
    audit = clean.audit_table(flagged.withColumn("_flagged", F.struct(*flagged.columns)), mapping, keep=["_flagged"])
    digest = F.md5(F.concat_ws("|", *[c for c in audit.columns if c not in ("row_order", "_flagged")])).alias("audit")
    ready = clean.ml_ready_table(audit.select("_flagged.*", digest), mapping, keep=["audit"])
    return ready.select("row_order", *[c for c in ready.columns if c != "row_order"])


@query
def delimited_scan_multiline(spark, sf):
    """Lines with line breaks in quoted cells, blank lines, short and long rows."""
    i = F.col("ordinal")
    note = F.when(i % 50 == 0, F.concat(F.lit('"first '), i.cast("string"), F.lit('\n\n, ""second"""'))).otherwise(
        F.concat(F.lit("note "), i.cast("string")))
    row = F.concat_ws(",", "time_raw", note, "flow_raw")
    value = F.when(i % 70 == 1, "").when(i % 90 == 2, F.col("time_raw")).when(i % 110 == 3, F.concat(row, F.lit(",more"))).otherwise(row)
    path = _as_file(spark, raw_readings(spark, sf), value, "multiline")
    cells_, _ = delimited.read_cells(spark, path, headers=["Time", "Note", "Flow"])
    placed = ordered.sorted_positions(cells_, [delimited.ORDINAL], "row_order")
    return placed.select("row_order", F.col("c0").alias("time_raw"), F.col("c1").alias("note"),
                         F.col("c2").alias("flow"), delimited.MISMATCH)


@query
def clean_to_model(spark, sf):
    """From a dirty file over the written ML-ready table to QC and scaling."""
    cell = F.transform("cells", lambda c: F.when(c.contains(" "), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c))
    path = _as_file(spark, ragged_cells(spark, sf).select("ordinal", F.array_join(cell, ",").alias("value")), label="chain")
    config = SeriesConfig(CONFIG.name, path, expected_gap_seconds=CADENCE, has_pump_state=True)
    result = clean.clean_series(spark, config, stage_path(spark, "cleaned"), mode="full", headers=HEADERS)
    written = spark.read.parquet(result.ml_path)
    result.release()
    scaler = ScalerConfig({"injection": "injection_ec"}, {}, "net_flow")
    scaled, _ = model_prep.prepare_for_model(
        written, scaler, written.columns, "injection_ec", "net_flow", MIN_FLOW, MIN_PRESSURE, ordinal="row_order",
        output=stage_path(spark, "model"))
    return scaled.select("row_order", "valve_a", *round6("injection_ec", "net_flow"))


@query
def big_integer_profile(spark, sf):
    """Whole numbers that doubles can't tell apart."""
    large = table(spark, sf, "lineitem").select((F.col("l_orderkey") + 9_007_199_254_740_992).alias("large"), "l_partkey")
    found = profile.numeric_profile(large, ["large", "l_partkey"])
    return found.select("column", *[F.col(f"whole_{k}").cast("string").alias(k) for k in ("minimum", "maximum", "range")],
                        "count", "unique_count")


@query
def subsecond_duplicate_keys(spark, sf):
    """Times a fraction of a second apart share a key."""
    part = F.make_dt_interval(secs=(F.col("event_id") % 5 * 0.19).cast("decimal(18,6)"))
    rows = table(spark, sf, "events").select(
        F.lit(CONFIG.name).alias("source_dataset"), (F.date_trunc("minute", "ts").cast("timestamp_ntz") + part).alias("ts"))
    return quality.duplicate_keys(rows)


@query
def datetime_detect_short(spark, sf):
    """Time texts in the feed's own format become times."""
    raw = raw_readings(spark, sf).select("ordinal", "short_raw", "valve_raw")
    return profile.detect_datetimes(raw, ["%m/%d/%y %H:%M:%S"])


@query
def variants_from_file(spark, sf):
    """The variant flow from a text file under its own headers."""
    path = stage_path(spark, "sensor")
    _sensor_file(spark, sf).orderBy("_ordinal").drop("_ordinal").write.csv(path, header=True)
    return variants.build_variants(delimited.read_named(spark, path)).normalized


@query
def total_clipped(spark, sf):
    data = channels(spark, sf)
    return outliers.total_clipped(data, outliers.fit_bounds(data, CHANNELS))


# Streams ---------------------------------------------------------------------------------


def _streamed(spark, sf):
    rows = parsed_readings(spark, sf).select("source_dataset", "ordinal", "ts")
    end = rows.agg(F.max("ordinal") + 1).first()[0]
    feed = stage_path(spark, "feed")
    flagger = StreamFlagger(stage_path(spark, "flags"), CADENCE)
    for k in range(3):  # three arrivals, each picked up by a run that continues the one before
        arrived = (F.col("ordinal") >= end * k // 3) & (F.col("ordinal") < end * (k + 1) // 3)
        rows.filter(arrived).write.mode("append").parquet(feed)
        flagger.start(spark.readStream.schema(rows.schema).parquet(feed)).awaitTermination()
    return flagger


@query
def stream_duplicate_runs(spark, sf):
    """Runs of repeats counted by micro-batch, also those that go over a batch's end."""
    return _streamed(spark, sf).run_lengths(spark)


@query
def stream_hourly_average(spark, sf):
    """Hours that the watermark closed; the last hour stays open."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select(
        F.lit(CONFIG.name).alias("source_dataset"), "ts", F.col("value").alias("pressure"))
    folder = stage_path(spark, "hourly")
    start_to_parquet(stream_window_average(stream, ["pressure"]), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("source_dataset", "window_start", "rows", *round6("pressure"))


@query
def stream_flags(spark, sf):
    """Flags by micro-batch with carried state: the same as on the whole table."""
    return spark.read.parquet(_streamed(spark, sf).rows_path).select("ordinal", *SEQUENCE_FLAGS)
