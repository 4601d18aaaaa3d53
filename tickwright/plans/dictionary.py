"""Profile flow: load a table, find its time columns, describe every column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.functions.names import trim_columns
from tickwright.operators.profile import column_stats, data_dictionary, dataset_summary, detect_datetimes, dictionary_document
from tickwright.session import Staged, stage_table
from tickwright.sources.delimited import ORDINAL, read_named
from tickwright.sources.sinks import write_document, write_profile
from tickwright.sources.tables import infer_types, load_table

ROW = "_row"


def profile_table(df: DataFrame, label: str, ordinal: str | None = None,
                  formats: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Data dictionary and dataset summary of a table; ``formats`` are those of its time texts
    besides ISO.

    First-seen examples need a row order; without ``ordinal`` the scan order is used, fixed
    by staging the table with a row number.
    """
    named = detect_datetimes(trim_columns(df), formats)
    exclude = [ROW] if ordinal is None else []
    ordered = named if ordinal else stage_table(named.withColumn(ROW, F.monotonically_increasing_id()), "profile")
    described = ordered.drop(ordinal) if ordinal else named
    return data_dictionary(ordered, ordinal or ROW, exclude or [ordinal]), dataset_summary(described, label)


def build_dictionary(spark: SparkSession, path: str | Sequence[str], output: str, description: str = "",
                     formats: Sequence[str] = ()) -> None:
    """Profile a table and write dictionary, dataset summary and dictionary document.

    A text file's cells are staged once, in the order of files and lines, and types, times and
    statistics come from the staged columns.  The statistics are computed once.
    """
    label = path if isinstance(path, str) else ", ".join(path)
    with Staged(spark):
        if label.rstrip("/").lower().endswith(".csv"):
            typed, ordinal = infer_types(read_named(spark, path, trim=False)), ORDINAL
        else:
            typed = load_table(spark, path)
            typed, ordinal = stage_table(typed.withColumn(ROW, F.monotonically_increasing_id()), "profile"), ROW
        rows = stage_table(detect_datetimes(trim_columns(typed), formats), "profile")
        stats = stage_table(column_stats(rows, ordinal, [ordinal]), "statistics")
        write_profile(data_dictionary(rows, ordinal, [ordinal], stats), dataset_summary(rows.drop(ordinal), label), output)
        write_document(dictionary_document(rows, ordinal, label, description, [ordinal], stats), f"{output}/dictionary_document")
