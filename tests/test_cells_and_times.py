from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickwright.functions import cells, times


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


def python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_numbers_match_python_float(spark):
    texts = ["1", "1.5", "-2", "+3.", ".5", "1e5", "1E-3", "nan", "-inf", "Infinity", "1_000", "1__0", "_1", "1.5d",
             "1.5f", "2D", "0x10", "0x1p3", "abc", "n/a", "1,5", "--1", "1e", "infd", "1e400"]
    got = column(spark, texts, lambda c: cells.as_number(cells.strip(c)))
    for text, value in zip(texts, got):
        want = python_float(text)
        same = value == want or (want is not None and value is not None and math.isnan(want) and math.isnan(value))
        assert same, (text, value, want)


def test_non_numeric_flag_passes_blank_and_missing(spark):
    assert column(spark, ["", None, "x", "1"], cells.is_non_numeric) == [False, False, True, False]


def test_strip_takes_python_whitespace(spark):
    texts = ["\t a b\n", "\xa0x ", "　", "plain"]
    assert column(spark, texts, cells.strip) == [t.strip() for t in texts]


def test_words(spark):
    texts = [" TRUE", "false ", "Open", "", None]
    assert column(spark, texts, cells.normalize_word) == ["true", "false", "open", "", None]
    assert column(spark, texts, cells.encode_boolean) == [1, 0, None, None, None]
    assert column(spark, ["On", " OFF ", "standby"], cells.encode_state) == [1, 0, None]


def test_rounding_matches_python(spark):
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 4) for _ in range(5000)]
    values += [0.0, -1e-9, 0.5, 2.5, 1e300, -3.25e15]
    got = column(spark, values, cells.round_half_even, "double")
    assert got == [round(v, 6) for v in values]
    # Beyond that, the spacing of doubles nears the sixth place and ties can go either way.
    large = [rng.uniform(-1, 1) * 10 ** rng.randint(5, 12) for _ in range(2000)]
    got = column(spark, large, cells.round_half_even, "double")
    assert all(abs(a - round(v, 6)) <= 1e-6 + abs(v) * 2.0**-52 for a, v in zip(got, large))
    assert column(spark, [0.125, 0.375], lambda c: cells.round_half_even(c, 2), "double") == [0.12, 0.38]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("time_format", ["%Y-%m-%d %H:%M:%S", "%m/%d/%y %H:%M:%S"])
def test_times_match_strptime(spark, zone, time_format):
    texts = ["2024-01-05 03:04:05", "2024-1-5 3:4:5", " 2024-01-05  03:04:05 ", "2024-02-30 00:00:00", "0000-01-01 00:00:00",
             "2024-03-10 02:30:00", "2024-01-05T03:04:05", "2024-01-05", "24-01-05 00:00:00", "2024-13-01 00:00:00",
             "2024-01-01 24:00:00", "2024-01-01 00:00:60", "1/5/24 3:4:5", "01/05/69 03:04:05", "12/31/68 23:59:59",
             "2/29/23 0:0:0", "2/29/24 0:0:0", "", "x", None, "1/5/2024 00:00:00", " 1/5/24 3:4"]

    def want(text):
        try:
            return datetime.strptime(text.strip(), time_format)
        except (ValueError, AttributeError):
            return None

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(spark, texts, lambda c: times.parse_time(c, time_format))
        assert got == [want(t) for t in texts]
        iso = column(spark, texts, lambda c: times.canonical_time(times.parse_time(c, time_format)))
        assert iso == [d.strftime("%Y-%m-%dT%H:%M:%S") if d else "" for d in map(want, texts)]
        back = column(spark, texts, lambda c: times.from_epoch_micros(times.epoch_micros(times.parse_time(c, time_format))))
        assert back == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unknown_directive_is_refused():
    with pytest.raises(ValueError, match="%j"):
        times.parse_time(F.lit("x") if False else None, "%Y-%j")


def test_calendar_and_cyclic_features(spark):
    moments = [datetime(2024, 12, 10, 21), datetime(2024, 12, 14, 0), datetime(2024, 12, 15, 23, 59)]
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
    rows = df.select("ts", *[c.alias(n) for n, c in {**times.calendar_features(F.col("ts")),
                                                    **times.cyclic_features(F.col("ts"))}.items()]).collect()
    for r in rows:
        t = r["ts"]
        assert (r["hour_of_day"], r["day_of_week"], r["month"]) == (t.hour, t.weekday(), t.month)
        assert r["is_weekend"] == int(t.weekday() >= 5)
        assert r["hour_sin"] == round(math.sin(2 * math.pi * t.hour / 24), 6)
        assert r["day_of_week_cos"] == round(math.cos(2 * math.pi * t.weekday() / 7), 6)


def test_lines_that_need_no_strip_have_no_cell_to_strip(spark):
    texts = ["a", "", "a b", " a", "a ", "\u00a0a", "a\u2003", "\ta", '" a"', '"a "', '"a"', '"a, b"']
    lines = [f"{one},{other}" for one in texts for other in texts]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    parsed = F.from_csv("line", F.lit("a string, b string"), {"quote": '"', "escape": '"'})
    whole = F.array(F.coalesce(parsed["a"], F.lit("")), F.coalesce(parsed["b"], F.lit("")))
    found = rows.select("line", cells.may_need_strip(F.col("line")).alias("may"), (F.transform(whole, cells.strip) != whole).alias("changes")).collect()
    assert [r.line for r in found if r.changes and not r.may] == []
    assert {r.line: r.may for r in found}["a b,a"] is False
