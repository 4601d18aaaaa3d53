from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwright.operators import resample, sequence
from tickwright.streaming.averages import late_rows, start_to_parquet, stream_window_average
from tickwright.streaming.flags import StreamFlagger

SCHEMA = "source_dataset string, ordinal long, ts timestamp_ntz, value double"


def feed_rows(n=300):
    rng, clock, rows = random.Random(2), 0, []
    for i in range(n):
        clock += rng.choice([0, 0, 60, 600, 601, 1200, -300])
        ts = None if rng.random() < 0.1 else datetime(2024, 1, 1) + timedelta(seconds=clock)
        rows.append((rng.choice(["hot", "hot", "b"]), i, ts, rng.random()))
    return rows


def test_flags_over_batches_equal_the_batch_result(spark, tmp_path):
    rows = feed_rows()
    feed, flagger = str(tmp_path / "feed"), StreamFlagger(str(tmp_path / "flags"), 600)
    for part in (rows[:1], rows[1:120], rows[120:121], rows[121:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(feed)
        flagger.start(spark.readStream.schema(SCHEMA).parquet(feed)).awaitTermination()
    columns = ["ordinal", *sequence.FLAGS[:4]]
    got = spark.read.parquet(flagger.rows_path).select(columns).orderBy("ordinal").collect()
    want = sequence.flag_sequence(spark.createDataFrame(rows, SCHEMA), 600).select(columns).orderBy("ordinal").collect()
    assert got == want


def test_runs_over_batches_equal_the_batch_result(spark, tmp_path):
    start = datetime(2024, 1, 1)
    steps = [0, 0, 0, 600, 0, 0, None, 0, 600, 0, 0, 0, 0, 600, 600, 0]
    rows, clock = [], 0
    for i, step in enumerate(steps * 3):
        clock += step or 0
        rows.append(("a" if i % 7 else None, i, None if step is None else start + timedelta(seconds=clock), 1.0))
    flagger = StreamFlagger(str(tmp_path / "flags"), 600)
    edges = [0, 3, 4, 11, 12, 30, len(rows)]
    for epoch, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        for _ in range(2):  # each batch twice
            flagger.process(spark.createDataFrame(rows[low:high], SCHEMA), epoch)
    flagged = sequence.flag_sequence(spark.createDataFrame(rows, SCHEMA), 600)
    want = {tuple(r) for r in sequence.duplicate_run_lengths(flagged).select("source_dataset", "run_length", "runs").collect()}
    assert {tuple(r) for r in flagger.run_lengths(spark).select("source_dataset", "run_length", "runs").collect()} == want


def test_batches_out_of_order_are_an_error(spark, tmp_path):
    rows, flagger = feed_rows(40), StreamFlagger(str(tmp_path / "flags"), 600)
    flagger.process(spark.createDataFrame(rows[20:], SCHEMA), 0)
    with pytest.raises(ValueError, match="order"):
        flagger.process(spark.createDataFrame(rows[:20], SCHEMA), 1)


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    rows, flagger = feed_rows(60), StreamFlagger(str(tmp_path / "flags"), 600)
    batches = [spark.createDataFrame(rows[:30], SCHEMA), spark.createDataFrame(rows[30:], SCHEMA)]
    for epoch, batch in ((0, batches[0]), (1, batches[1]), (1, batches[1])):
        flagger.process(batch, epoch)
    got = spark.read.parquet(flagger.rows_path)
    want = sequence.flag_sequence(spark.createDataFrame(rows, SCHEMA), 600)
    assert got.count() == 60
    for flag in sequence.FLAGS[:4]:
        assert got.filter(flag).count() == want.filter(flag).count()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_window_averages_drop_only_late_rows(spark, tmp_path, zone):
    start = datetime(2024, 3, 10)
    rows = [("s", i, start + timedelta(minutes=7 * i), float(i)) for i in range(100)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
        averages = lambda: stream_window_average(spark.readStream.schema(SCHEMA).parquet(feed), ["value"])
        spark.createDataFrame(rows, SCHEMA).write.parquet(feed)
        start_to_parquet(averages(), out).awaitTermination()
        late = [("s", 1000, start, 1e9)]
        spark.createDataFrame(late, SCHEMA).write.mode("append").parquet(feed)
        start_to_parquet(averages(), out).awaitTermination()
        got = {r["window_start"]: (r["rows"], r["value"]) for r in spark.read.parquet(out + "/rows").collect()}
        batch = resample.window_average(spark.createDataFrame(rows, SCHEMA), ["value"])
        want = {r["window_start"]: (r["rows"], r["value"]) for r in batch.collect()}
        newest = max(r[2] for r in rows) - timedelta(minutes=10)
        assert got == {w: v for w, v in want.items() if w + timedelta(hours=1) <= newest}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_late_rows_are_counted(spark, tmp_path):
    feed, start = str(tmp_path / "feed"), datetime(2024, 1, 1)
    counts = []
    for number, minutes in enumerate(([0, 10, 70, 200], [210, 5], [400])):  # minute 5 comes after the watermark passed its hour
        rows = [("s", number, start + timedelta(minutes=m), 1.0) for m in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(SCHEMA).parquet(feed)
        query = start_to_parquet(stream_window_average(stream, ["value"]), str(tmp_path / "out"))
        query.awaitTermination()
        counts.append(late_rows(query))
    assert counts == [0, 1, 0]
    found = {r["window_start"]: r["rows"] for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    assert found[start] == 2
