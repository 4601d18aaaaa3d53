from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickwright.config import SeriesConfig
from tickwright.functions import names

HEADERS = ["", "Time", "", "TL-TEC-INT-U", "Net Flow", "Valve A (True/False)", "(True/False)", "PT 403", "A - B",
           "Rate L/min", "X", "X", "X_2", "%%%", " Padded ", "Injection EC", "TU Packer Center Depth", "Unknown Thing",
           "Triplex On/Off"]


def test_header_mapping():
    mapping = names.header_mapping(HEADERS, SeriesConfig("s", has_pump_state=True))
    assert [f.clean for f in mapping] == [
        "raw_row_index", "time", "column_3", "tl_tec_int_u", "net_flow", "valve_a", "column_7", "pt_403", "a_b",
        "rate_l_min", "x", "x_2", "x_2_2", "column_14", "padded", "injection_ec", "tu_packer_center_depth",
        "unknown_thing", "triplex_on_off"]
    roles = {f.clean: f.role for f in mapping}
    assert roles["raw_row_index"] == "index" and roles["time"] == "time" and roles["triplex_on_off"] == "state"
    assert roles["valve_a"] == roles["column_7"] == "boolean" and roles["net_flow"] == "numeric"
    plain = names.header_mapping(HEADERS, SeriesConfig("s"))
    assert plain[-1].role == "numeric"


def test_header_mapping_needs_one_time_and_strips_the_mark():
    config = SeriesConfig("s")
    assert names.header_mapping([names.BYTE_ORDER_MARK + "Time", "A"], config)[0].role == "time"
    for headers in (["time", "A"], ["Time", "Time"]):
        with pytest.raises(ValueError, match="Time"):
            names.header_mapping(headers, config)


def test_ml_names():
    assert names.ml_names(["A - B", "Rate (L/min)", "a---b", "A_-_B"]) == [
        "a___b", "rate_l_per_min", "a___b_2", "a___b_3"]


def test_unique_names_never_collide():
    for given in (["x", "x", "x_2"], ["x", "x_2", "x"], ["x_2", "x", "x", "x_2_2", "x_2"]):
        assert len(set(names.unique_names(given))) == len(given)


def test_definitions_and_units():
    assert len(names.DEFINITIONS) == 68
    assert names.infer_definition("TL-TEC-BOT-L") == "Temperature TL bottom lower."
    assert "TS-TEC-INT-U" not in names.DEFINITIONS
    assert names.infer_definition("XX-TEC-1") == "Thermocouple temperature measurement for XX-TEC-1."
    assert names.infer_definition("pt 7") == "Pressure measurement for pt 7."
    assert names.infer_definition("tc_injecting") == "Field representing tc_injecting."
    assert [names.infer_unit(n) for n in ("Time", "Net Flow", "PT 403", "TL-TEC-INT-U", "TL Packer Center Depth",
                                          "Injection EC", "tc_injecting")] == [
        "datetime", "L/min", "psi", "C", "Feet", "EC units not explicitly stated", ""]


def test_column_forms_agree_with_the_list_forms(spark):
    df = spark.createDataFrame([(0, i, h) for i, h in enumerate(HEADERS)], "file int, position int, source string")
    source = F.col("source")
    clean = df.withColumn("clean", names.normalized_header(source, names.header_fallback(source, F.col("position"))))
    numbered = names.number_repeats(clean, "file", "position", "clean")
    roles = numbered.withColumn("role", names.header_role(source, F.col("clean"), True)).orderBy("position").collect()
    mapping = names.header_mapping(HEADERS, SeriesConfig("s", has_pump_state=True))
    assert [(r["clean"], r["role"]) for r in roles] == [(f.clean, f.role) for f in mapping]
    described = names.definition_column(df, "source").withColumn("unit", names.unit_column(source))
    for r in described.withColumn("ml", names.ml_name_column(source)).collect():
        assert r["definition"] == names.infer_definition(r["source"])
        assert r["unit"] == names.infer_unit(r["source"])
        assert r["ml"] == names.ml_name(r["source"])


def test_required_columns(spark):
    df = spark.range(1)
    names.require_columns(df, ["id"], "pressure")
    with pytest.raises(ValueError, match="pressure column.*p1"):
        names.require_columns(df, ["p1"], "pressure")
    assert names.trim_columns(df.withColumnRenamed("id", " id ")).columns == ["id"]
