"""QA counters, duplicate keys, the QA summary and the QC filter over a flagged table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.functions.cells import is_non_numeric
from tickwright.functions.times import canonical_time
from tickwright.operators.ordered import join_series
from tickwright.operators.sequence import SERIES, duplicate_run_lengths
from tickwright.operators.wide import per_column

# Array of the numeric columns' places whose cell in this row is no number.
BAD_CELLS = "_bad_cells"
# Counter name -> flag column.
COUNTERS = {
    "row_length_mismatches": "flag_row_length_mismatch",
    "timestamp_parse_failures": "flag_bad_timestamp_format",
    "non_monotonic_time_rows": "flag_non_monotonic_time",
    "duplicate_timestamp_rows": "flag_duplicate_timestamp",
    "time_gap_gt_expected_rows": "flag_time_gap_gt_expected",
    "rows_with_non_numeric_fields": "flag_non_numeric_in_numeric_field",
}


def _counters(ts: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows_processed"),
        *[F.count_if(F.col(flag)).alias(name) for name, flag in COUNTERS.items()],
        canonical_time(F.min(ts)).alias("time_min"),
        canonical_time(F.max(ts)).alias("time_max"),
    ]


def qa_counts(flagged: DataFrame, ts: str = "ts", series: Sequence[str] = SERIES) -> DataFrame:
    """Row counters and first and last time per series, in one aggregate."""
    return flagged.groupBy(*series).agg(*_counters(ts))


def with_counters(flagged: DataFrame, ts: str = "ts", series: str = SERIES[0]) -> tuple[DataFrame, Callable[[str], DataFrame]]:
    """The rows of one series, counted while they are written, and a function that gives
    :func:`qa_counts` of the named series once they are: no row, if there was none."""
    seen = Observation()

    def counts(name: str) -> DataFrame:
        found = seen.get
        schema = f"{series} string, rows_processed long, {', '.join(f'{c} long' for c in COUNTERS)}, time_min string, time_max string"
        row = (name, found["rows_processed"], *[found[c] for c in COUNTERS], found["time_min"], found["time_max"])
        return flagged.sparkSession.createDataFrame([row] if found["rows_processed"] else [], schema)

    return flagged.observe(seen, *_counters(ts)), counts


def duplicate_keys(flagged: DataFrame, ts: str = "ts", series: Sequence[str] = SERIES) -> DataFrame:
    """Times that occur more than once, next to each other or not, by the whole second."""
    parsed = flagged.filter(F.col(ts).isNotNull())
    second = F.date_trunc("second", F.col(ts).cast("timestamp_ntz")).alias("__second")
    counted = parsed.groupBy(*series, second).agg(F.count("*").alias("count")).filter("count > 1")
    return counted.select(*series, canonical_time(F.col("__second")).alias("time"), "count")


def duplicate_examples(keys: DataFrame, n: int = 10, series: Sequence[str] = SERIES) -> DataFrame:
    """The first ``n`` repeated times of each series."""
    rank = F.row_number().over(W.partitionBy(*series).orderBy("time"))
    return keys.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def count_cells(df: DataFrame, tests: dict[str, Column], series: Sequence[str] = SERIES,
                name: str = "column", count: str = "bad_cells") -> DataFrame:
    """Cells per column that pass a test, as rows (series, column, position, count)."""
    if not tests:
        schema = f"{name} string, position int, {count} bigint"
        return df.select(*series, F.inline(F.array().cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))
    return per_column(df, [
        F.struct(F.lit(c).alias(name), F.lit(i).alias("position"), F.count_if(test).alias(count))
        for i, (c, test) in enumerate(tests.items())
    ], series)


def offending_columns(df: DataFrame, numeric: Sequence[str], series: Sequence[str] = SERIES) -> DataFrame:
    """Numeric columns with cells that are no numbers, and how many.

    Where the rows carry the places of such cells, those are counted and nothing is parsed.
    """
    if BAD_CELLS in df.columns and numeric:
        names = F.array(*[F.lit(c) for c in numeric])
        found = df.select(*series, F.explode(BAD_CELLS).alias("at")).groupBy(*series, "at").agg(F.count("*").alias("bad_cells"))
        return found.select(*series, names[F.col("at")].alias("column"), "bad_cells")
    counted = count_cells(df, {c: is_non_numeric(F.col(c)) for c in numeric}, series)
    return counted.filter("bad_cells > 0").drop("position")


def qc_filter(df: DataFrame, flags: Sequence[str] = ("flag_duplicate_timestamp", "flag_time_gap_gt_expected")) -> DataFrame:
    """Keep rows whose flags are all false; a missing flag drops the row as well.

    Flags are booleans, 0/1 numbers as in the ML-ready table, or ``true``/``false`` text as in
    the audit table; other text counts as missing.
    """
    kinds = dict(df.dtypes)
    for flag in flags:
        if kinds[flag] == "boolean":
            raised = F.col(flag)
        elif kinds[flag] == "string":
            word = F.lower(F.trim(F.col(flag)))
            raised = F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)
        else:
            raised = F.col(flag) != 0
        df = df.filter(~raised)
    return df


def qa_summary(flagged: DataFrame, numeric: Sequence[str], ts: str = "ts",
               series: Sequence[str] = SERIES, ordinal: str = "ordinal",
               constants: dict[str, Column] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One nested row per series: counters, repeated keys, runs, offending columns.

    ``counts`` are the counters, if they were taken before (:func:`with_counters`).

    Every input of the joins is one row per series.  The collected groups are small by
    construction: ten examples, one entry per column, one entry per distinct run length.
    """
    key = list(series)
    keys = duplicate_keys(flagged, ts, series)
    key_counts = keys.groupBy(*key).agg(F.count("*").alias("duplicate_timestamp_keys"))
    examples = duplicate_examples(keys, 10, series).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("time", "count"))).alias("duplicate_timestamp_examples"))
    runs = duplicate_run_lengths(flagged, series, ordinal).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("run_length", "runs"))).alias("__runs"))
    bad = offending_columns(flagged, numeric, series).groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "bad_cells"))))
        .alias("offending_numeric_columns"))

    joined = qa_counts(flagged, ts, series) if counts is None else counts
    for part in (key_counts, examples, runs, bad):
        joined = join_series(joined, part, key)
    run_map = F.map_from_entries(F.transform(
        F.coalesce("__runs", F.array().cast("array<struct<run_length:bigint,runs:bigint>>")),
        lambda r: F.struct(r["run_length"].cast("string"), r["runs"])))
    result = joined.withColumns({
        "duplicate_timestamp_keys": F.coalesce("duplicate_timestamp_keys", F.lit(0)),
        "duplicate_timestamp_examples": F.coalesce(
            "duplicate_timestamp_examples", F.array().cast("array<struct<time:string,count:bigint>>")),
        "consecutive_duplicate_run_lengths": run_map,
        "offending_numeric_columns": F.coalesce(
            "offending_numeric_columns", F.create_map().cast("map<string,bigint>")),
    }).drop("__runs")
    return result.withColumns(constants or {})
