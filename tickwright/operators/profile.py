"""Column profiles and the data dictionary."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwright.functions.cells import missing_percent, round_half_even, strip
from tickwright.functions.names import definition_column, named, schema_values, unit_column
from tickwright.functions.times import epoch_micros, from_epoch_micros, parse_time
from tickwright.operators.quality import count_cells
from tickwright.operators.quantiles import exact_percentiles, numeric_column
from tickwright.operators.wide import per_column

# The fields of the data dictionary, in order.
DICTIONARY_FIELDS = (
    "Term", "Definition", "Type", "Minimum", "Maximum", "Mean", "Median", "Range", "Unit",
    "Std Dev", "Count", "Missing Count", "Missing Percent", "Unique Count", "Example Values",
)


def logical_type(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.FractionalType):
        return "numeric" if isinstance(data_type, T.DecimalType) else "float"
    return "string"


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {"number": [], "time": [], "text": []}
    for f in df.schema.fields:
        kind = logical_type(f.dataType)
        group = "number" if kind in ("integer", "float", "numeric") else "time" if kind == "datetime" else "text"
        kinds[group].append(f.name)
    return kinds


def detect_datetimes(df: DataFrame, formats: Sequence[str] = (), threshold: float = 0.8) -> DataFrame:
    """Turn text columns into timestamps where more than ``threshold`` of all rows parse.

    Without formats, ISO-like text counts.  One aggregate tests every text column.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parsed = {c: parsed_datetime(named(c), formats) for c in names}
    if not names:
        return df
    shares = per_column(df, [
        F.struct(F.lit(c).alias("column"), F.avg(p.isNotNull().cast("int")).alias("share"))
        for c, p in parsed.items()
    ])
    chosen = [r["column"] for r in shares.filter(F.col("share") > threshold).collect()]
    return df.withColumns({c: parsed[c] for c in chosen}) if chosen else df


def parsed_datetime(c: Column, formats: Sequence[str] = ()) -> Column:
    if formats:
        return F.coalesce(*[parse_time(c, f) for f in formats])
    # The plain cast would also take a bare number as a year.
    text = strip(c)
    return F.when(text.contains("-"), text.try_cast("timestamp_ntz"))


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Exact number of distinct non-missing values: (column, unique_count).

    Counting in one wide aggregate would expand every row once per column before the
    shuffle.  In long form equal values are merged before the shuffle, and the shuffle key
    is (column, value), so neither a wide table nor a frequent value overloads a task.
    """
    unique = unpivot_values(df, values).distinct().groupBy("at").agg(F.count("*").alias("unique_count"))
    return unique.select(_label(values), "unique_count")


def unpivot_values(df: DataFrame, values: dict[str, Column], *keep: Column) -> DataFrame:
    """Rows (kept columns, at, value) of the non-missing values.

    ``at`` is the position of the column; it is shorter to shuffle than the name.
    """
    kept = {f"_k{i}": c for i, c in enumerate(keep)}
    cells = {str(i): c for i, c in enumerate(values.values())}
    wide = df.select(*[c.alias(name) for name, c in {**kept, **cells}.items()])
    return wide.unpivot(list(kept), list(cells), "at", "value").filter("value IS NOT NULL")


def _label(columns: Iterable[str]) -> Column:
    """Name of the column at position ``at``."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at").cast("int") + 1).alias("column")


def _with_distinct(stats: DataFrame, distinct: DataFrame) -> DataFrame:
    joined = stats.join(distinct, "column", "left")
    return joined.withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))


def numeric_profile(df: DataFrame, columns: Sequence[str], **limits: int) -> DataFrame:
    """Minimum, maximum, mean, median, range, sample deviation, counts; NaN is missing.

    Whole-number columns also have ``whole_minimum``, ``whole_maximum`` and ``whole_range``, and
    their distinct values are counted, without going through doubles.
    """
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}

    def exact(c: str) -> Column:
        return named(c).cast("decimal(20,0)") if c in whole else F.lit(None).cast("decimal(20,0)")

    stats = per_column(df, [
        F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"),
            F.min(exact(c)).alias("whole_minimum"), F.max(exact(c)).alias("whole_maximum"),
            F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std_dev"), F.count(v).alias("count"),
            (F.count("*") - F.count(v)).alias("missing_count"), F.count("*").alias("__rows"))
        for i, (c, v) in enumerate((c, numeric_column(c)) for c in columns)
    ])
    medians = exact_percentiles(df, columns, [0.5], **limits)
    median = F.create_map(*[F.lit(x) for c, m in medians.items() for x in (c, m[0])]).cast("map<string,double>")
    stats = stats.withColumns({
        "median": F.element_at(median, F.col("column")),
        "range": F.col("maximum") - F.col("minimum"),
        "whole_range": (F.col("whole_maximum") - F.col("whole_minimum")).cast("decimal(20,0)"),
        "missing_percent": missing_percent(F.col("missing_count"), F.col("__rows")),
    }).drop("__rows")
    parts = []
    for group, value in ((whole, lambda c: named(c).cast("long")), (set(columns) - whole, numeric_column)):
        if own := {c: value(c) for c in columns if c in group}:
            parts.append(distinct_counts(df, own))
    return _with_distinct(stats, reduce(DataFrame.unionAll, parts))


def datetime_profile(df: DataFrame, columns: Sequence[str], **limits: int) -> DataFrame:
    """As the numeric profile, over microseconds; the range is an interval."""
    micros = df.select(*[epoch_micros(named(c)).alias(c) for c in columns])
    stats = per_column(micros, [
        F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"),
            F.min(t).alias("__min"), F.max(t).alias("__max"),
            F.floor(F.avg(t.cast("decimal(20,0)"))).cast("long").alias("__mean"),
            F.count(t).alias("count"), (F.count("*") - F.count(t)).alias("missing_count"),
            F.count("*").alias("__rows"))
        for i, (c, t) in enumerate((c, named(c)) for c in columns)
    ])
    medians = exact_percentiles(micros, columns, [0.5], **limits)
    median = F.create_map(*[
        F.lit(x) for c, m in medians.items() for x in (c, None if m[0] is None else int(m[0]))
    ]).cast("map<string,bigint>")
    stats = stats.select(
        "column", "position",
        from_epoch_micros(F.col("__min")).alias("minimum"),
        from_epoch_micros(F.col("__max")).alias("maximum"),
        from_epoch_micros(F.col("__mean")).alias("mean"),
        from_epoch_micros(F.element_at(median, F.col("column"))).alias("median"),
        (from_epoch_micros(F.col("__max")) - from_epoch_micros(F.col("__min"))).alias("range"),
        "count", "missing_count",
        missing_percent(F.col("missing_count"), F.col("__rows")).alias("missing_percent"),
    )
    return _with_distinct(stats, distinct_counts(micros, {c: named(c) for c in columns}))


def _as_text(df: DataFrame, c: str) -> Column:
    text = named(c).cast("string")
    return F.initcap(text) if isinstance(df.schema[c].dataType, T.BooleanType) else text


def text_profile(df: DataFrame, columns: Sequence[str], ordinal: str, examples: int = 5) -> DataFrame:
    """Counts, distinct values and the first distinct values in order of appearance.

    Values are merged per (column, value) with their first row; the rank filter keeps five
    rows per task ahead of the shuffle to the final ranking.
    """
    values = (
        unpivot_values(df, {c: _as_text(df, c) for c in columns}, F.col(ordinal))
        .groupBy("at", "value").agg(F.min("_k0").alias("__first"))
    )
    rank = F.row_number().over(W.partitionBy("at").orderBy("__first", "value"))
    firsts = values.withColumn("__rank", rank).filter(F.col("__rank") <= examples)
    shown = firsts.groupBy("at").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("__rank", "value"))), lambda e: e["value"]), ", ").alias("example_values"))
    stats = per_column(df, [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.count(named(c)).alias("count"),
                 (F.count("*") - F.count(named(c))).alias("missing_count"), F.count("*").alias("__rows"))
        for i, c in enumerate(columns)
    ]).withColumn(
        "missing_percent", missing_percent(F.col("missing_count"), F.col("__rows"))).drop("__rows")
    # Counting the same column that the ranking needs lets both share one shuffle.
    unique = values.groupBy("at").agg(F.count("__first").alias("unique_count"))
    joined = _with_distinct(stats, unique.select(_label(columns), "unique_count"))
    joined = joined.join(shown.select(_label(columns), "example_values"), "column", "left")
    return joined.withColumn("example_values", F.coalesce("example_values", F.lit("")))


def number_text(c: Column) -> Column:
    """A number as the shortest text that gives the same number again; whole ones have no point."""
    whole = (F.abs(c) < F.lit(1e15)) & (c == F.floor(c))
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def column_stats(df: DataFrame, ordinal: str, exclude: Sequence[str] = (), **limits: int) -> DataFrame:
    """Typed statistics of every column: one row each, numbers and times in own fields."""
    table = df.drop(*exclude) if exclude else df
    kinds = columns_by_kind(table)
    parts = []
    if kinds["number"]:
        parts.append(numeric_profile(df, kinds["number"], **limits).drop("position"))
    if kinds["time"]:
        times = datetime_profile(df, kinds["time"], **limits).drop("position")
        parts.append(times.withColumnsRenamed(
            {k: f"{k}_time" for k in ("minimum", "maximum", "mean", "median", "range")}))
    if kinds["text"]:
        parts.append(text_profile(df, kinds["text"], ordinal).drop("position"))
    stats = parts[0]
    for part in parts[1:]:
        stats = stats.unionByName(part, allowMissingColumns=True)
    optional = {
        **{k: "double" for k in ("minimum", "maximum", "mean", "median", "range", "std_dev")},
        **{f"whole_{k}": "decimal(20,0)" for k in ("minimum", "maximum", "range")},
        **{f"{k}_time": "timestamp_ntz" for k in ("minimum", "maximum", "mean", "median")},
        "range_time": "interval day to second", "example_values": "string",
    }
    stats = stats.withColumns({
        k: F.lit(None).cast(t) for k, t in optional.items() if k not in stats.columns})
    names = table.columns
    place = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    kind = F.create_map(*[F.lit(x) for f in table.schema.fields for x in (f.name, logical_type(f.dataType))])
    return stats.withColumns({
        "position": F.element_at(place, F.col("column")), "type": F.element_at(kind, F.col("column"))})


def data_dictionary(df: DataFrame, ordinal: str, exclude: Sequence[str] = (), stats: DataFrame | None = None,
                    **limits: int) -> DataFrame:
    """The dictionary table: fifteen text fields per column, in column order.  ``stats`` can hold
    statistics that were computed before.  Definitions and units that the schema's metadata has,
    as in what the cleaning flow writes, are taken from there."""
    stats = column_stats(df, ordinal, exclude, **limits) if stats is None else stats

    def shown(name: str) -> Column:
        time = F.replace(F.col(f"{name}_time").cast("string"), F.lit("T"), F.lit(" "))
        exact = F.col(f"whole_{name}").cast("string") if name in ("minimum", "maximum") else F.lit(None)
        return F.coalesce(exact, number_text(F.col(name)), time)

    seconds = F.timestamp_diff("SECOND", F.col("minimum_time"), F.col("maximum_time"))
    described = definition_column(stats, "column", "__definition")
    definition = F.coalesce(schema_values(df, F.col("column"), "definition"), F.col("__definition"))
    unit = F.coalesce(schema_values(df, F.col("column"), "unit"), unit_column(F.col("column")))
    return described.orderBy("position").select(
        F.col("column").alias("Term"), definition.alias("Definition"), F.col("type").alias("Type"),
        shown("minimum").alias("Minimum"), shown("maximum").alias("Maximum"), shown("mean").alias("Mean"),
        shown("median").alias("Median"),
        F.coalesce(F.col("whole_range").cast("string"), number_text(F.col("range")), F.concat(seconds.cast("string"), F.lit(" s"))).alias("Range"),
        unit.alias("Unit"), number_text(F.col("std_dev")).alias("Std Dev"),
        F.col("count").alias("Count"), F.col("missing_count").alias("Missing Count"),
        F.col("missing_percent").alias("Missing Percent"), F.col("unique_count").alias("Unique Count"),
        F.coalesce("example_values", F.lit("")).alias("Example Values"),
    )


def dataset_summary(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("Rows")).select(
        F.lit(label).alias("Dataset File"), "Rows", F.lit(len(df.columns)).alias("Columns"))


def dictionary_document(df: DataFrame, ordinal: str, dataset: str, description: str,
                        exclude: Sequence[str] = (), stats: DataFrame | None = None, **limits: int) -> DataFrame:
    """One row {dataset, description, fields[]}; the list has one entry per column."""
    stats = column_stats(df, ordinal, exclude, **limits) if stats is None else stats
    stats = definition_column(stats, "column", "definition")
    definition = F.coalesce(schema_values(df, F.col("column"), "definition"), F.col("definition")).alias("definition")
    unit = F.coalesce(schema_values(df, F.col("column"), "unit"), unit_column(F.col("column"))).alias("unit")
    field = F.struct(
        "position", F.col("column").alias("term"), definition, "type", "minimum", "maximum", "mean",
        "median", "range", unit, "std_dev", "count",
        "missing_count", "missing_percent", "unique_count", "example_values")
    fields = F.transform(F.array_sort(F.collect_list(field)), lambda f: f.dropFields("position"))
    return stats.agg(fields.alias("fields")).select(
        F.lit(dataset).alias("dataset"), F.lit(description).alias("description"), "fields")


# Quick looks -----------------------------------------------------------------------------


def blank_counts(df: DataFrame, columns: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Cells per column that are blank after trimming; missing cells count as blank."""
    blank = {c: strip(F.coalesce(F.col(c), F.lit(""))) == "" for c in columns}
    return count_cells(df, blank, series, "column", "blanks").drop("position")


def value_frequency(df: DataFrame, column: str, places: int = 1, top: int = 10) -> DataFrame:
    """The most common rounded values; ties go to the smaller value."""
    rounded = df.select(round_half_even(F.col(column).cast("double"), places).alias("value"))
    return rounded.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(top)


def sign_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Positive and non-positive cells per column."""
    return per_column(df, [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) > 0).alias("positive"),
                 F.count_if(F.col(c) <= 0).alias("non_positive"))
        for c in columns
    ])


def distinct_sample(df: DataFrame, column: str, places: int = 4, first: int = 10) -> DataFrame:
    """The smallest distinct rounded values."""
    rounded = df.select(round_half_even(F.col(column).cast("double"), places).alias("value"))
    return rounded.distinct().orderBy("value").limit(first)
