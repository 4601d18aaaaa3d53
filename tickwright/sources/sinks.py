"""Writers for audit, ML-ready and variant tables, parameters, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_by_series(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per series; a long series is written by as many tasks as hold its rows."""
    writer = df.write.mode("overwrite").partitionBy("source_dataset")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> tuple[int, int]:
    """Write with a header line; returns rows and columns, counted during the write."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").csv(path, header=True, escape='"')
    return seen.get["rows"], len(df.columns)


def write_document(df: DataFrame, path: str) -> None:
    """Small nested result (QA summary, dictionary) as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_params(params: DataFrame, path: str) -> None:
    """Scaler parameters, one row per column, in one CSV file."""
    params.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_profile(dictionary: DataFrame, summary: DataFrame, path: str) -> None:
    """Data dictionary and dataset summary as two tables under ``path``."""
    for name, table in (("data_dictionary", dictionary), ("dataset_summary", summary)):
        renamed = table.toDF(*[c.lower().replace(" ", "_") for c in table.columns])
        renamed.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
