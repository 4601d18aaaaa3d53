"""What several operators share: words, staged tables and blocks of a total order."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.session import stage_table

#: A word is a longest run of characters outside space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, so that other columns can't clash; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(divisor))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python holds about ``most`` bytes of text at a time, or one
    row if that is longer."""
    for batch in batches:
        sizes = batch.column(column)
        start, held = 0, 0
        lengths = pa.compute.binary_length(sizes).to_pylist()
        for row, length in enumerate(lengths):
            if held and held + (length or 0) > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def with_package(df: DataFrame) -> DataFrame:
    """Let Python workers find this package where the driver has it; a cluster's workers have
    it installed."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))
    return df


def in_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` that gives ``function`` bounded slices of (doc_id, text, ...)."""

    def run(batches):
        for batch in slices(batches):
            yield from function(batch)

    return with_package(df).mapInArrow(run, schema)


def stage(df: DataFrame, label: str) -> DataFrame:
    """A written table in the folder that all executors share."""
    return stage_table(df, f"llm-{label}")


def block_bits(rows: int, per_block: int) -> int:
    """So many high bits of a random key that a block holds about ``per_block`` rows."""
    return max(0, -(-rows // per_block) - 1).bit_length()


def broadcast_if_small(df: DataFrame, label: str, most_rows: int = 50_000) -> DataFrame:
    """Stage ``df`` and hint a broadcast if it has no more than ``most_rows`` rows; beyond
    that Spark is left to join as it will."""
    table = stage(df, label)
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table
