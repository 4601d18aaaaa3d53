from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.inputs import flagged_readings
from tickwright.operators import features, quality, sequence
from tickwright.operators.ordered import sorted_positions

START = datetime(2024, 1, 1)
CADENCE = 10


def random_series(seed, rows, sparse=False):
    """(series, ordinal, ts): repeats, backward steps, gaps, missing times; one series is hot."""
    rng = random.Random(seed)
    data, clock, at = [], Counter(), Counter()
    for _ in range(rows):
        name = "hot" if rng.random() < 0.7 else rng.choice(["a", "b"])
        at[name] += rng.choice([1, 1, 3, 5000]) if sparse else 1
        clock[name] += rng.choice([0, 0, 0, 5, 10, 11, 40, -7])
        ts = None if rng.random() < 0.1 else START + timedelta(seconds=clock[name])
        data.append((name, at[name] - 1, ts))
    return data


def row_loop(data):
    """The flag rules as a loop with carried state."""
    flags, runs, previous, length = {}, Counter(), {}, Counter()
    for name, ordinal, ts in sorted(data, key=lambda r: (r[0], r[1])):
        bad = ts is None
        before = previous.get(name)
        step = None if bad or before is None else int((ts - before).total_seconds())
        backward, repeat, gap = (step is not None and test for test in (step is not None and step < 0, step == 0,
                                                                         step is not None and step > CADENCE))
        if repeat:
            length[name] = (length[name] or 1) + 1
        else:
            if length[name] > 1:
                runs[name, length[name]] += 1
            length[name] = 1
        flags[name, ordinal] = (bad, backward, repeat, gap, before)
        if not bad:
            previous[name] = ts
    for name, n in length.items():
        if n > 1:
            runs[name, n] += 1
    return flags, runs


@pytest.mark.parametrize("seed,rows,bits,levels,sparse", [
    (1, 400, 3, 1, False), (2, 400, 0, 1, False), (3, 400, 2, 3, False), (4, 300, 4, 3, True), (5, 50, 20, 1, False)])
def test_flags_and_runs_match_the_row_loop(spark, seed, rows, bits, levels, sparse):
    data = random_series(seed, rows, sparse)
    shuffled = data[:]
    random.Random(0).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "source_dataset string, ordinal long, ts timestamp_ntz").repartition(5)
    flagged = sequence.flag_sequence(df, CADENCE, bits=bits, levels=levels)
    want, want_runs = row_loop(data)
    got = {(r["source_dataset"], r["ordinal"]): (
        r["flag_bad_timestamp_format"], r["flag_non_monotonic_time"], r["flag_duplicate_timestamp"],
        r["flag_time_gap_gt_expected"], r["prev_valid_time"]) for r in flagged.collect()}
    assert got == want
    runs = sequence.duplicate_run_lengths(flagged, bits=bits, levels=levels).collect()
    assert Counter({(r["source_dataset"], r["run_length"]): r["runs"] for r in runs}) == want_runs
    for bad, backward, repeat, gap, _ in got.values():
        assert backward + repeat + gap + bad <= 1


@pytest.fixture
def plain_plans(spark):
    """Plans as they are without broadcasts and without changes at run time."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_are_exchanged_once(spark, plain_plans):
    """Window, and the join with the chunk table, share one exchange and one sort of the rows."""
    wide = spark.createDataFrame([("s", i, START, f"x{i}") for i in range(9)], "source_dataset string, ordinal long, ts timestamp_ntz, payload string")
    flagged = sequence.flag_sequence(wide, CADENCE)
    stepped = features.delta_ratio(wide.withColumns({"p": F.length("payload"), "q": F.length("payload")}), "p", "q", ordinal="ordinal")
    for frame in (flagged, stepped):
        tree = frame._jdf.queryExecution().executedPlan()
        # Exchanges of the chunk tables have no payload.
        assert nodes_with(tree, "Exchange", "payload") == 1
        assert nodes_with(tree, "Sort", "payload") == 1


def nodes_of(tree):
    yield tree
    children = tree.children()
    for at in range(children.size()):
        yield from nodes_of(children.apply(at))


def nodes_with(tree, kind, column):
    return sum(1 for node in nodes_of(tree) if node.nodeName() == kind and f"{column}#" in node.output().toString())


def test_a_series_without_a_name_is_a_series(spark):
    data = [(None if n == "hot" else n, o, t) for n, o, t in random_series(12, 300)]
    df = spark.createDataFrame(data, "source_dataset string, ordinal long, ts timestamp_ntz").repartition(4)
    want, want_runs = row_loop([("none" if n is None else n, o, t) for n, o, t in data])
    flagged = sequence.flag_sequence(df, CADENCE, bits=3)
    got = {(r["source_dataset"] or "none", r["ordinal"]): r["prev_valid_time"] for r in flagged.collect()}
    assert got == {key: flags[-1] for key, flags in want.items()}
    runs = sequence.duplicate_run_lengths(flagged, bits=3).collect()
    assert Counter({(r["source_dataset"] or "none", r["run_length"]): r["runs"] for r in runs}) == want_runs
    placed = sequence.row_index(df, "ts", "ordinal", ("source_dataset",)).collect()
    assert len(placed) == len(data)
    for name in {n for n, _, _ in data}:
        own = sorted((r for r in placed if r["source_dataset"] == name), key=lambda r: r["row_index"])
        assert [r["row_index"] for r in own] == list(range(len(own)))
        order = [(r["ts"] is not None, r["ts"] or START, r["ordinal"]) for r in own]
        assert order == sorted(order)
    summary = {r["source_dataset"]: r for r in quality.qa_summary(flagged.withColumns(
        {"flag_row_length_mismatch": F.lit(False), "flag_non_numeric_in_numeric_field": F.lit(True), "n": F.lit("x")}), ["n"]).collect()}
    mine = summary[None]
    times = Counter(t for n, _, t in data if n is None and t is not None)
    assert mine["duplicate_timestamp_keys"] == sum(c > 1 for c in times.values()) > 0
    assert len(mine["duplicate_timestamp_examples"]) == min(10, mine["duplicate_timestamp_keys"])
    assert mine["consecutive_duplicate_run_lengths"] == {str(n): c for (name, n), c in want_runs.items() if name == "none"}
    assert mine["offending_numeric_columns"] == {"n": sum(n is None for n, _, _ in data)}


def test_runs_that_span_whole_chunks(spark):
    data = [("s", i, START) for i in range(100)] + [("s", 100, None)] + [("s", i, START) for i in range(101, 120)]
    df = spark.createDataFrame(data, "source_dataset string, ordinal long, ts timestamp_ntz")
    flagged = sequence.flag_sequence(df, CADENCE, bits=2)
    runs = sequence.duplicate_run_lengths(flagged, bits=2).collect()
    # The row without a time ends the first run; the rows after it repeat the time before it.
    assert {r["run_length"]: r["runs"] for r in runs} == {100: 1, 20: 1}


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_result_does_not_depend_on_partitions(spark, partitions):
    data = random_series(9, 300)
    df = spark.createDataFrame(data, "source_dataset string, ordinal long, ts timestamp_ntz").repartition(partitions)
    rows = sequence.flag_sequence(df, CADENCE, bits=4).filter("flag_duplicate_timestamp").count()
    assert rows == sum(f[2] for f in row_loop(data)[0].values())


def test_known_counts_of_the_dirty_fixture(spark, sf):
    flagged = flagged_readings(spark, sf)
    counts = flagged.agg(*[F.count_if(F.col(f)).alias(f) for f in sequence.FLAGS], F.count("*").alias("rows")).first()
    assert counts["rows"] == 1000
    assert [counts[f] for f in sequence.FLAGS] == [11, 5, 12, 767, 17, 12]
    assert {r["run_length"]: r["runs"] for r in sequence.duplicate_run_lengths(flagged).collect()} == {2: 12}


def test_row_index_is_a_stable_sort(spark):
    rng = random.Random(3)
    data = [(rng.choice("xy"), i, START + timedelta(seconds=rng.choice([0, 0, 1, 2]))) for i in range(500)]
    df = spark.createDataFrame(data, "s string, ordinal long, time timestamp_ntz").repartition(7)
    got = {r["ordinal"]: r["row_index"] for r in sequence.row_index(df).collect()}
    assert got == {r[1]: i for i, r in enumerate(sorted(data, key=lambda r: (r[2], r[1])))}
    per = {(r["s"], r["ordinal"]): r["row_index"] for r in sequence.row_index(df, series=["s"]).collect()}
    for s in "xy":
        ranked = sorted((r for r in data if r[0] == s), key=lambda r: (r[2], r[1]))
        assert [per[s, r[1]] for r in ranked] == list(range(len(ranked)))


def test_positions_of_no_rows(spark):
    empty = spark.createDataFrame([], "a long, b string")
    assert sorted_positions(empty, ["a"]).count() == 0


@pytest.mark.parametrize("bits,levels", [(2, 1), (1, 4), (20, 1)])
def test_delta_ratio_matches_a_loop(spark, bits, levels):
    rng = random.Random(8)
    data = [(s, i, rng.choice([1.0, 2.5, 7.0, None]), rng.choice([1.0, 2.0, 4.0])) for s in "pq" for i in range(60)]
    df = spark.createDataFrame(data, "source_dataset string, ordinal long, p double, q double").repartition(4)
    got = {(r[0], r[1]): r["delta_P_delta_Q"] for r in
           features.delta_ratio(df, "p", "q", places=None, bits=bits, levels=levels).collect()}
    for s in "pq":
        before = None
        for name, i, p, q in (r for r in data if r[0] == s):
            ratio = 0.0
            if before is not None and q != before[1] and p is not None and before[0] is not None:
                ratio = (p - before[0]) / (q - before[1])
            assert got[name, i] == ratio
            before = (p, q)


def test_a_null_series_is_a_series(spark):
    start = datetime(2024, 1, 1)
    rows = [(None, i, start + timedelta(seconds=60 * (i // 10))) for i in range(10)] + [("a", i, start) for i in range(3)]
    df = spark.createDataFrame(rows, "source_dataset string, ordinal long, ts timestamp_ntz")
    flagged = sequence.flag_sequence(df, 600, bits=1)
    counts = {r[0]: r[1] for r in flagged.groupBy("source_dataset").agg(F.count_if("flag_duplicate_timestamp")).collect()}
    assert counts == {None: 9, "a": 2}
    runs = {tuple(r) for r in sequence.duplicate_run_lengths(flagged, bits=1).collect()}
    assert runs == {(None, 10, 1), ("a", 3, 1)}
