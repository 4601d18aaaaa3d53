from __future__ import annotations

import csv
import io
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwright.config import ScalerConfig, SeriesConfig, SeriesRegistry
from tickwright.functions.names import infer_definition, infer_unit
from tickwright.operators.sequence import FLAGS
from tickwright.plans import clean, dictionary, model_prep, variants
from tickwright.sources import delimited, sinks, tables

HEADER = "Time,Valve A (True/False),Net Flow,TL-TEC-INT-U,PT 403"
LINES = [
    "2024-01-01 00:00:00,True,1.5,20,100",
    "2024-01-01 01:00:00,False,1e5",
    "2024-01-01 02:00:00, TRUE , 2.5 ,21,101,extra",
    "",
    '2024-01-01 03:00:00,"maybe,not",nan,22,102',
    "2024-01-01 03:00:00,false,abc,n/a,103",
    "2024-01-01 01:30:00,true,,23,104",
    "2024-01-01 03:30:00,true,1,23,104",
    "   ",
    '2024-01-01 06:00:00,true,"1 ""q""",24,105',
    "2024-1-1 7:0:0,true,3,25,106",
]


def reference_rows(lines, header=HEADER):
    """Cells, mismatch flag and time of each line by the documented rules."""
    width = len(header.split(","))
    for row in csv.reader(io.StringIO("\n".join(lines) + "\n")):
        cells = [c.strip() for c in (row + [""] * width)[:width]]
        try:
            ts = datetime.strptime(cells[0], "%Y-%m-%d %H:%M:%S")
        except ValueError:
            ts = None
        yield cells, len(row) != width, ts


@pytest.fixture
def log_file(tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


def test_cells_and_row_shape(spark, log_file):
    cells, mapping = delimited.read_series(spark, SeriesConfig("s", log_file))
    got = cells.orderBy(delimited.ORDINAL).collect()
    want = list(reference_rows(LINES))
    assert len(got) == len(LINES)
    for r, (expected, mismatch, _) in zip(got, want):
        assert [r["time_raw"], r["valve_a"], r["net_flow"], r["tl_tec_int_u"], r["pt_403"]] == expected
        assert r[delimited.MISMATCH] == mismatch
    assert [f.role for f in mapping] == ["time", "boolean", "numeric", "numeric", "numeric"]


def test_order_over_splits_and_files(spark, tmp_path):
    """A file of several splits, and several files: the ordinal follows files, then lines."""
    rows = 150_000
    big = tmp_path / "a.csv"
    big.write_text("Time,N\n" + "".join(f"2024-01-01 00:00:00,{i:040d}\n" for i in range(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        cells, _ = delimited.read_series(spark, SeriesConfig("s", str(big)))
        assert cells.rdd.getNumPartitions() > 3
        ordered = [int(r["n"]) for r in cells.orderBy(delimited.ORDINAL).select("n").collect()]
        assert ordered == list(range(rows))
        (tmp_path / "b.csv").write_text("Time,N\n2024-01-01 00:00:00,900001\nTime,N\n")
        (tmp_path / "c.csv").write_text("Time,N\n2024-01-01 00:00:00,900002\n")
        cells, _ = delimited.read_series(spark, SeriesConfig("s", str(tmp_path)))
        ordered = [r["n"] for r in cells.orderBy(delimited.ORDINAL).select("n").collect()]
        assert [int(n) for n in ordered[:rows]] == list(range(rows))
        # Only each file's first line is its header; a later one is data.
        assert ordered[rows:] == ["900001", "N", "900002"]
        assert cells.select(delimited.ORDINAL).distinct().count() == rows + 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def cells_of(spark, path, **options):
    cells, mapping = delimited.read_series(spark, SeriesConfig("s", str(path)), **options)
    names = ["time_raw" if f.role == "time" else f.clean for f in mapping]
    return [([r[n] for n in names], r[delimited.MISMATCH]) for r in cells.orderBy(delimited.ORDINAL).collect()]


def read_by_rules(path):
    with open(path, newline="") as file:
        header, *rows = csv.reader(file)
    return [([c.strip() for c in (row + [""] * len(header))[:len(header)]], len(row) != len(header)) for row in rows]


QUOTED = [
    'Time,A,B', '2024-01-01 00:00:00,"x', 'y",1', '', '2024-01-01 01:00:00,2', '2024-01-01 02:00:00,"a, ""b""', '', 'c","d', 'e"',
    'plain,5" pipe,q', '"t","u,v",w', '', '', 'z,"",""', '"open', '"",a', 'b",2,3', 'last,1,2,3',
]


@pytest.mark.parametrize("split", ["256", "40b", "128m"])
def test_line_breaks_and_blank_lines_follow_the_csv_rules(spark, tmp_path, split):
    path = tmp_path / "my log.csv"
    path.write_text("\n".join(QUOTED) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert cells_of(spark, path) == read_by_rules(path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_with_a_line_break(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('Time,"A\nB",C\n2024-01-01 00:00:00,1,2\n')
    cells, mapping = delimited.read_series(spark, SeriesConfig("s", str(path)))
    assert [f.clean for f in mapping] == ["time", "a_b", "c"]
    assert [(r["a_b"], r["c"]) for r in cells.collect()] == [("1", "2")]


def test_an_unclosed_quote_is_an_error(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('Time,A\n2024-01-01 00:00:00,"x\n' + "y,1\n" * 40_000)
    with pytest.raises(ValueError, match="not closed"):
        delimited.read_cells(spark, str(path))


def test_a_long_record_of_shorter_cells_is_read(spark, tmp_path):
    """The limit is on a cell, not on the record that it is in."""
    path, part = tmp_path / "l.csv", "z" * 50_000
    path.write_text(f'Time,A,B,C\n2024-01-01 00:00:00,"{part}\n{part}",{part},"{part}\n"\n2024-01-01 00:00:01,1,2,3\n')
    cells, _ = delimited.read_cells(spark, str(path), trim=False)
    rows = cells.orderBy(delimited.ORDINAL).collect()
    assert [r["c1"] for r in rows] == [f"{part}\n{part}", "1"] and rows[0]["c3"] == part + "\n"
    path.write_text(f"Time,A\n2024-01-01 00:00:00,{part * 3}\n")
    with pytest.raises(ValueError, match="not closed"):
        delimited.read_cells(spark, str(path))


def test_row_numbers_move_no_cells(spark, tmp_path):
    """Split starts are broadcast even where Spark would not: the cell table has no exchange."""
    path = tmp_path / "n.csv"
    path.write_text("Time,N\n" + "".join(f"2024-01-01 00:00:00,{i}\n" for i in range(1000)))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "2048"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        cells, _ = delimited.read_cells(spark, str(path))
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        assert sorted((r[0], r["c1"]) for r in cells.select(delimited.ORDINAL, "c1").collect()) == [(i + 1, str(i)) for i in range(1000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_splits_with_equal_hashes_take_another_seed(spark):
    splits = spark.createDataFrame([("f", 0), ("f", 1)], "_file string, _block long")
    key, keyed = delimited._split_keys(splits)
    assert keyed.select("_key").distinct().count() == 2 and "xxhash64" in str(key)


def test_splits_of_any_size_keep_every_row(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("Time,N\n" + "".join(f"2024-01-01 00:00:00,{i}\n" for i in range(60_000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        cells, _ = delimited.read_series(spark, SeriesConfig("s", str(path)))
        assert [int(r["n"]) for r in cells.orderBy(delimited.ORDINAL).select("n").collect()] == list(range(60_000))
        assert cells.select(delimited.ORDINAL).distinct().count() == 60_000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_sample_reads_the_first_split_alone(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Time,N\n" + "".join(f"2024-01-01 00:00:00,{i:0200d}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        spark.sparkContext.setJobGroup("sample", "lines of a sample")
        lines = delimited._first_lines(spark, str(path), 101)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("sample") for s in tracker.getJobInfo(j).stageIds]
        assert len(lines) == 101 and spark.read.text(str(path)).rdd.getNumPartitions() > 2
        assert stages and all(stage is None or stage.numTasks == 1 for stage in stages)
        assert [int(cells[1]) for cells, _ in cells_of(spark, path, row_limit=100)] == list(range(100))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_sample_goes_over_files_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,A,B\n" + "\n".join(QUOTED[1:7]) + '\nc",1\n')
    (tmp_path / "b.csv").write_text("Time,A,B\n2024-01-02 00:00:00,1,2\n2024-01-02 01:00:00,3,4\n")
    whole = cells_of(spark, tmp_path)
    assert whole == read_by_rules(tmp_path / "a.csv") + read_by_rules(tmp_path / "b.csv")
    for limit in range(1, len(whole) + 2):
        assert cells_of(spark, tmp_path, row_limit=limit) == whole[:limit]


def test_wide_tables_keep_generated_code(spark, tmp_path):
    """At the width of real files no step falls back from whole-stage code generation."""
    path = tmp_path / "w.csv"
    path.write_text("Time," + ",".join(f"Chan {i}" for i in range(67)) + "\n"
                    + "".join(f"2024-01-01 00:00:{k:02d}," + ",".join(str(k * i) for i in range(67)) + "\n" for k in range(50)))
    config = SeriesConfig("w", str(path))
    cells, mapping = delimited.read_series(spark, config)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it runs, with its generated code
    try:
        flagged = clean.flag_rows(cells, mapping, config)
        debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
        sizes = debug.codegenStringSeq(flagged._jdf.queryExecution().executedPlan())
        longest = max(sizes.apply(i)._3().maxMethodCodeSize() for i in range(sizes.length()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < longest < 64_000
    assert [r["chan_66"] for r in flagged.orderBy(delimited.ORDINAL).collect()] == [str(k * 66) for k in range(50)]


def test_a_flow_leaves_only_its_outputs(spark, log_file, tmp_path):
    from tickwright.session import stage_root

    root = stage_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    result = clean.clean_series(spark, SeriesConfig("s", log_file), str(tmp_path / "out"), mode="full")
    assert len(set(os.listdir(root)) - before) == 1
    result.release()
    assert set(os.listdir(root)) == before


def test_from_dirty_file_to_scaled_rows(spark, tmp_path):
    """The written ML-ready table goes through QC and scaling in file order."""
    path = tmp_path / "chain.csv"
    rows = [f"2024-01-01 {k:02d}:00:00,{k * k},{k % 5}" for k in range(20)]
    path.write_text("Time,Injection Pressure,Net Flow\n" + "\n".join([*rows[:10], rows[9], *rows[10:]]) + "\n")
    result = clean.clean_series(spark, SeriesConfig("s", str(path)), str(tmp_path / "out"), mode="full")
    written = spark.read.parquet(result.ml_path)
    config = ScalerConfig({"inj": "injection_pressure"}, {"inj": "delta_P_delta_Q"}, "net_flow", ("tc_injecting", "tc_producing"))
    out = str(tmp_path / "scaled")
    scaled, _ = model_prep.prepare_for_model(written, config, written.columns, "injection_pressure", "net_flow", 0.5, 2.0,
                                             ordinal="row_order", output=out)
    assert scaled.count() == 20 == spark.read.parquet(out).count()
    order = [r["row_order"] for r in scaled.orderBy("row_order").collect()]
    assert order == [*range(1, 11), *range(12, 22)]  # the header is line 0
    audit = spark.read.parquet(result.audit_path)
    from tickwright.operators.quality import qc_filter
    assert qc_filter(audit).count() == qc_filter(written).count() == 20


def test_names_that_the_flow_uses_itself(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("Time,Prev Valid Time,Flag Duplicate Timestamp,Triplex On/Off\n2024-01-01 00:00:00,7,8,On\n")
    result = clean.clean_series(spark, SeriesConfig("s", str(path)), str(tmp_path / "out"), mode="full")
    row = spark.read.parquet(result.audit_path).first()
    assert (row["prev_valid_time"], row["flag_duplicate_timestamp_2"], row["flag_duplicate_timestamp"]) == ("7", "8", "false")
    assert row["triplex_on_off"] == "on"


def test_clean_flow(spark, log_file, tmp_path):
    config = SeriesConfig("s", log_file)
    result = clean.clean_series(spark, config, str(tmp_path / "out"), mode="full")
    flagged = result.flagged.orderBy(delimited.ORDINAL).collect()
    previous, want = None, []
    for cells, mismatch, ts in reference_rows(LINES):
        step = None if ts is None or previous is None else int((ts - previous).total_seconds())
        bad_number = False
        for cell in cells[2:]:
            try:
                float(cell or 0)
            except ValueError:
                bad_number = True
        want.append((ts is None, step is not None and step < 0, step == 0, step is not None and step > 3600,
                     mismatch, bad_number))
        previous = ts or previous
    assert [tuple(r[f] for f in FLAGS) for r in flagged] == want

    audit = spark.read.parquet(result.audit_path)
    assert audit.count() == len(LINES) and len(audit.columns) == 1 + 3 + 4 + 6
    assert audit.filter("valve_a = 'maybe,not'").count() == 1
    assert {d for _, d in audit.drop("source_dataset", "row_order").dtypes} == {"string"}
    ml = spark.read.parquet(result.ml_path)
    assert len(ml.columns) == 1 + 2 + 4 + 6 and "time_raw" not in ml.columns
    assert dict(ml.dtypes)["net_flow"] == "double" and dict(ml.dtypes)[FLAGS[0]] == "int"
    assert ml.agg(F.sum("valve_a"), F.count("valve_a")).first() == (6, 8)
    about = ml.schema["net_flow"].metadata
    assert about["role"] == "numeric" and about["source"] == result.mapping[2].source and about["unit"] == infer_unit(about["source"])
    terms = {r["Term"]: r for r in dictionary.profile_table(ml, "ml", "row_order")[0].collect()}
    assert terms["valve_a"]["Definition"] == infer_definition("Valve A (True/False)")
    assert terms["net_flow"]["Definition"] == infer_definition(about["source"]) and terms["net_flow"]["Unit"] == about["unit"]

    summary = spark.read.json(result.summary_path).first()
    assert summary["dataset"] == "s" and summary["mode"] == "full" and summary["row_limit"] is None
    assert summary["rows_processed"] == len(LINES)
    assert summary["timestamp_parse_failures"] == sum(w[0] for w in want)
    assert summary["duplicate_timestamp_keys"] == 1
    assert summary["duplicate_timestamp_examples"][0].asDict() == {"time": "2024-01-01T03:00:00", "count": 2}
    assert summary["consecutive_duplicate_run_lengths"].asDict() == {"2": 1}
    assert summary["offending_numeric_columns"].asDict() == {"net_flow": 2, "tl_tec_int_u": 1}
    assert [m.asDict() for m in summary["header_mapping"]][1] == {"source": "Valve A (True/False)", "clean": "valve_a"}
    assert clean.mapping_table(spark, result.mapping).count() == 5


def test_sample_mode_and_registry(spark, log_file, tmp_path):
    other = tmp_path / "sec.csv"
    other.write_text(",Time,Triplex On/Off\n0,1/5/24 0:0:0,On\n1,1/5/24 0:0:1,OFF\n2,1/5/24 0:0:9,x\n")
    registry = SeriesRegistry([SeriesConfig("s", log_file), SeriesConfig("f", str(other), "%m/%d/%y %H:%M:%S", 1, True)])
    results = clean.clean_all(spark, registry, str(tmp_path / "out"), sample_rows=2, fmt="csv")
    assert set(results) == {"s", "f"}
    assert all(r.flagged.count() == 2 for r in results.values())
    assert "/data/sample/" in results["s"].audit_path
    ml = spark.read.csv(results["f"].ml_path, header=True)
    assert [r["triplex_on_off"] for r in ml.orderBy("time").collect()] == ["1", "0"]
    assert "raw_row_index" not in ml.columns
    audit = spark.read.csv(results["f"].audit_path, header=True)
    assert "raw_row_index" in audit.columns
    with pytest.raises(ValueError, match="unknown series"):
        registry.select("nope")
    with pytest.raises(ValueError, match="unique"):
        SeriesRegistry([SeriesConfig("s"), SeriesConfig("s")])


def test_series_beside_each_other_equal_one_by_one(spark, tmp_path):
    configs = []
    for at in range(5):
        path = tmp_path / f"in{at}.csv"
        path.write_text("Time,A\n" + "".join(f"2024-01-01 0{i % 3 + at}:00:00,{'x' if i == at else i}\n" for i in range(12)))
        configs.append(SeriesConfig(f"s{at}", str(path), expected_gap_seconds=600 * (at + 1)))
    registry = SeriesRegistry(configs)
    seen = {}
    for at_once in (1, 4):
        results = clean.clean_all(spark, registry, str(tmp_path / f"out{at_once}"), mode="full", at_once=at_once)
        assert list(results) == [c.name for c in configs]
        seen[at_once] = [
            [sorted(map(str, spark.read.parquet(p).collect())) for p in (r.audit_path, r.ml_path)]
            + [spark.read.json(r.summary_path).drop("output_path", "ml_ready_output_path").collect()] for r in results.values()]
        for result in results.values():
            result.release()
            with pytest.raises(Exception, match="(?i)path.*not|exist"):
                spark.read.parquet(result.staged).count()
    assert seen[1] == seen[4]


def test_clean_identities_on_monotonic_rows(spark, tmp_path):
    """rows - repeats = distinct times, and the run histogram adds up to the repeats."""
    start, lines, at = datetime(2024, 1, 1), [], 0
    for i in range(500):
        at += 0 if i % 7 == 3 or i % 50 == 4 else 1 if i % 90 else 5
        lines.append(f"{start + timedelta(hours=at)},{i}")
    path = tmp_path / "m.csv"
    path.write_text("Time,A\n" + "\n".join(lines) + "\n")
    result = clean.clean_series(spark, SeriesConfig("m", str(path)), str(tmp_path / "out"), mode="full")
    s = spark.read.json(result.summary_path).first()
    distinct = result.flagged.select(clean.TIME).distinct().count()
    runs = {int(k): v for k, v in s["consecutive_duplicate_run_lengths"].asDict().items()}
    assert s["rows_processed"] - s["duplicate_timestamp_rows"] == distinct
    assert sum((k - 1) * v for k, v in runs.items()) == s["duplicate_timestamp_rows"]
    assert sum(runs.values()) == s["duplicate_timestamp_keys"]


def test_load_table(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,f,b,t,gap,none,mixed\n1,1.5,True,a,1,,1\n2,NA,False,b,,,x\n3,2,True,c,3,NA,2\n")
    df = tables.load_table(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "gap": "double",
                               "none": "double", "mixed": "string"}
    assert [r["f"] for r in df.collect()] == [1.5, None, 2.0]
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert tables.load_table(spark, str(tmp_path / "t.parquet")).count() == 3
    df.write.json(str(tmp_path / "t.json"))
    assert tables.load_table(spark, str(tmp_path / "t.json")).count() == 3
    assert tables.load_table(spark, str(path), "i long, f string").dtypes[0] == ("i", "bigint")
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError, match="unsupported file type"):
        tables.load_table(spark, str(tmp_path / "t.xlsx"))


def sensor_rows(spark, n=200):
    return spark.range(n).select(
        F.col("id").alias("_ordinal"),
        F.date_format(F.timestamp_seconds(1_700_000_000 + (F.lit(n) - F.col("id")) * 3600), "yyyy-MM-dd HH:mm:ss").alias("Time"),
        (F.col("id") * F.lit(1.23456789)).cast("string").alias("TL Interval Pressure"),
        F.lit("177.8").alias("TU Packer Center Depth"), F.col("id").cast("string").alias("Net Flow"))


def test_variant_flow(spark, tmp_path):
    result = variants.build_variants(sensor_rows(spark))
    assert result.basic.columns == ["row_index", "time", "tl_interval_pressure", "net_flow"]
    first = result.basic.orderBy("row_index").first()
    assert first["row_index"] == 0 and first["net_flow"] == 199.0  # the file ran backwards
    assert len(result.features.columns) == 4 + 8
    low, high = result.normalized.agg(F.min("net_flow"), F.max("net_flow")).first()
    assert (low, high) == (0.0, 1.0)
    sizes = variants.write_variants(result, str(tmp_path / "v"))
    assert sizes == {"basic": (200, 4), "clipped": (200, 4), "features": (200, 12), "normalized": (200, 4)}
    params = spark.read.csv(str(tmp_path / "v/normalization_params"), header=True, inferSchema=True)
    assert [r["column"] for r in params.collect()] == ["tl_interval_pressure", "net_flow"]
    assert {r["column"]: (r["min"], r["max"]) for r in params.collect()}["net_flow"] == (1.99, 197.01)


def test_variant_errors(spark):
    broken = sensor_rows(spark).withColumn("Net Flow", F.when(F.col("_ordinal") == 3, "").otherwise(F.col("Net Flow")))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        variants.basic_variant(broken)
    basic, _ = variants.basic_variant(broken, on_error="null")
    assert basic.filter("net_flow IS NULL").count() == 1
    with pytest.raises(ValueError):
        variants.typed_numbers(broken, [], "skip")


def test_dictionary_flow(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text(" Time ,Net Flow,Valve,Note v1.0\n2024-01-01 00:00:00,1,True,b\n2024-01-01 02:00:00,3,False,\n"
                    "2024-01-02 00:00:00,8,True,a\n")
    dictionary.build_dictionary(spark, str(path), str(tmp_path / "out"), "A test")
    rows = {r["term"]: r for r in spark.read.parquet(str(tmp_path / "out/data_dictionary")).collect()}
    assert list(rows) == ["Time", "Net Flow", "Valve", "Note v1.0"]
    flow = rows["Net Flow"]
    assert (flow["type"], flow["minimum"], flow["mean"], flow["median"], flow["range"], flow["unit"]) == (
        "integer", "1", "4", "3", "7", "L/min")
    assert flow["definition"] == "Injection water flow rate from Triplex pump."
    assert float(flow["std_dev"]) == pytest.approx(3.605551)
    time = rows["Time"]
    assert (time["type"], time["median"], time["range"], time["unique_count"]) == (
        "datetime", "2024-01-01 02:00:00", "86400 s", 3)
    assert rows["Valve"]["example_values"] == "True, False"
    assert (rows["Note v1.0"]["missing_percent"], rows["Note v1.0"]["example_values"]) == (33.33, "b, a")
    summary = spark.read.parquet(str(tmp_path / "out/dataset_summary")).first()
    assert (summary["rows"], summary["columns"]) == (3, 4)
    text = next((tmp_path / "out/dictionary_document").glob("part-*")).read_text()
    document = json.loads(text)
    assert [f["term"] for f in document["fields"]] == ["Time", "Net Flow", "Valve", "Note v1.0"]
    assert document["fields"][1]["mean"] == 4.0 and document["fields"][0]["mean"] is None


def test_dictionary_follows_files_lines_and_formats(spark, tmp_path):
    """First-seen order is that of files by name; a cell may hold a line break; own time formats."""
    folder = tmp_path / "logs.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('When,Note,N\n1/2/24 3:04:05,"first\nline",9007199254740993\n')
    (folder / "b.csv").write_text("When,Note,N\n" + "".join(f"1/{d % 28 + 1}/24 0:0:0,second,{9007199254740992 + d % 2}\n" for d in range(2000)))
    dictionary.build_dictionary(spark, str(folder), str(tmp_path / "out"), formats=["%m/%d/%y %H:%M:%S"])
    rows = {r["term"]: r for r in spark.read.parquet(str(tmp_path / "out/data_dictionary")).collect()}
    assert rows["Note"]["example_values"] == "first\nline, second"
    assert rows["When"]["type"] == "datetime" and rows["When"]["minimum"].startswith("2024-01-01")
    assert (rows["N"]["minimum"], rows["N"]["maximum"], rows["N"]["range"], rows["N"]["unique_count"]) == (
        "9007199254740992", "9007199254740993", "1", 2)
    assert rows["Note"]["count"] == 2001


def test_small_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(0.0, 1), (2e-9, 2)], "x double, _o int")
    terms, _ = dictionary.profile_table(df, "x", "_o")
    row = terms.first()
    assert float(row["Maximum"]) == 2e-9 and float(row["Mean"]) == 1e-9 and row["Minimum"] == "0"


def test_named_reads_keep_text_and_skip_blank_lines(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,,a\n x ,1,2\n\ny,,3\n")
    df = delimited.read_named(spark, str(path), trim=False)
    assert df.columns == [delimited.ORDINAL, "a", "Unnamed: 1", "a.1"]
    assert [tuple(r)[1:] for r in df.orderBy(delimited.ORDINAL).collect()] == [(" x ", "1", "2"), ("y", "", "3")]


def test_profile_table_uses_scan_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "t string").coalesce(1)
    terms, summary = dictionary.profile_table(df, "x")
    assert terms.first()["Example Values"] == "b, a" and summary.first()["Rows"] == 3


def test_model_flow(spark):
    config = ScalerConfig({"inj": "p"}, {"inj": "delta_P_delta_Q"}, "q", ("tc_injecting", "tc_producing"))
    rows = [("s", i, float(i % 5), float(i % 3), i % 10 == 0, False) for i in range(50)]
    df = spark.createDataFrame(rows, "source_dataset string, ordinal long, p double, q double, "
                                     "flag_duplicate_timestamp boolean, flag_time_gap_gt_expected boolean")
    out, model = model_prep.prepare_for_model(df, config, df.columns, "p", "q", 0.5, 2.0)
    assert out.count() == 45 and model.params.count() == 3
    mean, deviation = out.agg(F.avg("p"), F.stddev_pop("p")).first()
    assert abs(mean) < 1e-9 and deviation == pytest.approx(1.0)
    assert {r[0] for r in out.select("tc_injecting").distinct().collect()} == {0, 1}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "source_dataset string, v double")
    assert sinks.write_csv(df, str(tmp_path / "c")) == (2, 2)
    sinks.write_by_series(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").glob("source_dataset=*")) == ["source_dataset=a", "source_dataset=b"]
