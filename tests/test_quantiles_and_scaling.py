from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickwright.config import ScalerConfig
from tickwright.operators import outliers, resample, scaling
from tickwright.operators.quantiles import exact_percentiles

FRACTIONS = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]


def interpolated(values, p):
    ranked = sorted(v for v in values if v is not None and not math.isnan(v))
    if not ranked:
        return None
    place = p * (len(ranked) - 1)
    low = math.floor(place)
    high = min(low + 1, len(ranked) - 1)
    return ranked[low] * (1 - (place - low)) + ranked[high] * (place - low)


def columns(seed, n):
    rng = random.Random(seed)
    return {
        "uniform": [rng.random() for _ in range(n)],
        "heavy": [rng.gauss(0, 1) ** 9 for _ in range(n)],
        "third": [7.5 if rng.random() < 0.4 else rng.gauss(7.5, 1) for _ in range(n)],
        "two": [float(rng.choice([0, 1])) for _ in range(n)],
        "constant": [3.0] * n,
        "floor": [-1100.0 if rng.random() < 0.02 else rng.uniform(0, 5000) for _ in range(n)],
        "gaps": [None if rng.random() < 0.3 else math.nan if rng.random() < 0.1 else rng.random() for _ in range(n)],
        "nothing": [None] * n,
        "infinite": [rng.choice([math.inf, -math.inf, 1.0, 2.0, 3.0]) for _ in range(n)],
    }


@pytest.mark.parametrize("n,open_values,accuracy", [
    (3000, 10, 50), (3000, 1, 20), (3000, 100_000, 5000), (2, 5, 100), (1, 5, 100), (100, 3, 2)])
def test_percentiles_match_a_sort(spark, n, open_values, accuracy):
    data = columns(n + accuracy, n)
    names = list(data)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in names)).repartition(6)
    got = exact_percentiles(df, names, FRACTIONS, max_open_values=open_values, accuracy=accuracy)
    for c in names:
        for p, value in zip(FRACTIONS, got[c]):
            want = interpolated(data[c], p)
            same = value == want or (want is not None and math.isnan(want) and math.isnan(value))
            assert same, (c, p, value, want)


def test_percentiles_of_no_rows(spark):
    df = spark.createDataFrame([], "a double")
    assert exact_percentiles(df, ["a"], [0.5]) == {"a": [None]}
    assert exact_percentiles(df, [], [0.5]) == {}


def test_clip_and_counts(spark):
    values = [float(v) for v in range(101)] + [None]
    df = spark.createDataFrame([(v, 5.0) for v in values], "a double, flat double")
    bounds = outliers.fit_bounds(df, ["a", "flat"])
    assert bounds == {"a": (1.0, 99.0), "flat": (5.0, 5.0)}
    clipped = outliers.winsorize(df, bounds)
    assert clipped.agg(F.min("a"), F.max("a"), F.count("a")).first() == (1.0, 99.0, 101)
    assert [tuple(r) for r in outliers.clip_counts(df, bounds).collect()] == [("a", 2)]
    again = outliers.winsorize(clipped, bounds)
    assert sorted(map(str, again.collect())) == sorted(map(str, clipped.collect()))


def test_zero_variance(spark):
    df = spark.createDataFrame([(177.8, 1.0), (177.8 + 3e-14, 2.0)], "depth double, p double")
    assert outliers.zero_variance_columns(df, ["depth", "p"]) == ["depth"]
    assert outliers.drop_zero_variance(df, ["depth", "p"]).columns == ["p"]


def test_rounding_leaves_text_alone(spark):
    df = spark.createDataFrame([("1.23456789", 0.12345678), ("n/a", None)], "t string, d double")
    assert [tuple(r) for r in outliers.round_columns(df, ["t", "d"]).collect()] == [("1.234568", 0.123457), ("n/a", None)]


def test_minmax_and_inverse(spark):
    df = spark.createDataFrame([(2.0, 9.0), (4.0, 9.0), (None, 9.0), (6.0, 9.0)], "a double, flat double")
    ranges = scaling.collect_ranges(scaling.minmax_params(df, ["a", "flat"]))
    scaled = scaling.minmax_scale(df, ranges)
    assert [tuple(r) for r in scaled.collect()] == [(0.0, 0.0), (0.5, 0.0), (None, 0.0), (1.0, 0.0)]
    assert [r["a"] for r in scaling.minmax_inverse(scaled, ranges).collect()] == [2.0, 4.0, None, 6.0]


CONFIG = ScalerConfig({"w1": "p1", "w2": "p2"}, {"w1": "ratio", "w2": "other"}, "flow", ("on",))


def model_table(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(100, 5), 177.8 + rng.choice([0.0, 3e-14]), rng.random(), rng.gauss(0, 1) ** 5, rng.random() < 0.5)
            for _ in range(200)]
    rows[3] = (None, 177.8, 0.5, None, True)
    return rows, spark.createDataFrame(rows, "p1 double, p2 double, flow double, ratio double, on boolean")


def test_scaler_values(spark, tmp_path):
    rows, df = model_table(spark)
    model = scaling.fit_scaler(df, CONFIG)
    out = model.transform(df)
    got = out.collect()
    p1 = [r[0] for r in rows if r[0] is not None]
    mean, std = statistics.fmean(p1), statistics.pstdev(p1)
    ratios = [r[3] for r in rows if r[3] is not None]
    mid, width = interpolated(ratios, 0.5), interpolated(ratios, 0.9) - interpolated(ratios, 0.1)
    for raw, r in zip(rows, got):
        assert (r["p1"] is None) == (raw[0] is None)
        if raw[0] is not None:
            assert r["p1"] == pytest.approx((raw[0] - mean) / std)
            assert r["ratio"] == pytest.approx((raw[3] - mid) / width)
        assert abs(r["p2"]) < 1e-9  # constant but for rounding noise: divided by one
        assert r["other"] == 0.0 and r["on"] == int(raw[4])
    back = model.inverse(out).select("p1", "flow").collect()
    assert [b["p1"] for b in back] == [None if r[0] is None else pytest.approx(r[0]) for r in rows]
    model.save(str(tmp_path / "m"))
    again = scaling.ScalerModel.load(spark, str(tmp_path / "m"), CONFIG).transform(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_ratio_absent_when_fitting_becomes_zero(spark):
    _, df = model_table(spark)
    out = scaling.fit_scaler(df.drop("ratio"), CONFIG).transform(df)
    assert out.filter("ratio != 0.0 OR other != 0.0").count() == 0


@pytest.mark.parametrize("column", ["p1", "flow", "on"])
def test_missing_columns_are_named(spark, column):
    _, df = model_table(spark)
    with pytest.raises(ValueError, match=column):
        scaling.fit_scaler(df.drop(column), CONFIG)


def test_scaling_is_a_projection(spark):
    _, df = model_table(spark)
    plan = scaling.fit_scaler(df, CONFIG).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_chronological_split(spark):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(101)")
    train, rest = resample.chronological_split(df, 0.8)
    assert (train.count(), rest.count()) == (81, 20)
    assert train.agg(F.max("ts")).first()[0] < rest.agg(F.min("ts")).first()[0]
    with pytest.raises(ValueError):
        resample.split_time(df.filter("id < 0"), 0.8)
