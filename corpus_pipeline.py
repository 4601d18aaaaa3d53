"""From raw documents to packed training sequences, in five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.llm.common import broadcast_if_small, documents, stage
from tickwright.llm.language_id import known_language
from tickwright.llm.line_dedup import dedup_lines
from tickwright.llm.minhash import near_duplicates
from tickwright.llm.mixing import mix_documents
from tickwright.llm.packing import pack_documents

#: Near-duplicates share at least 80 of 100 five-word shingles.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that are mostly noise or without letters go.

    Null and empty texts go.  A row is judged by its text, so repeated rows share their fate;
    ids may be null.  Without any labelled row nothing is learned and nothing stays; an empty
    table gives an empty one.
    """
    return known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that was nothing else goes whole.

    Null and empty texts stay as they are.  Rows are in order of their id, nulls first, so of
    repeated rows with enough words one is left.  ``n_chars`` follows where the text changed.
    """
    deduped = dedup_lines(docs)
    left = deduped.filter((F.size("removed") == 0) | (F.size("removed") < F.col("n_lines")))
    changed = F.size("removed") > 0
    columns = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumns(columns).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Decided by row, not by id: of repeated rows one stays, a text goes only if it is itself
    like one that stays, and rows without an id stay only where no row of the group has one.
    Null texts and texts without words are like nothing and all stay.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    verdicts = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width=SHINGLE, percent=PERCENT)
    verdicts = verdicts.select(F.col("doc_id").alias(row), "component_id")
    owners = rows.select(row, F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"))
    groups = (verdicts.join(owners, row).groupBy("component_id")
              .agg(F.count("*").alias("members"), F.min(F.struct("unnamed", "id", row)).alias("first")))
    groups = groups.filter("members > 1").select("component_id", F.col("first")[row].alias("stays"))
    gone = verdicts.join(groups, "component_id").filter(F.col(row) != F.col("stays")).select(row)
    return rows.join(broadcast_if_small(gone, "near-gone", 500_000), row, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document can come in several epochs.

    Null and empty texts have no words: they are taken as often as whole epochs of their source
    are.  A null source is a source.  Rows equal in source, id and size are taken alike, so a
    source exceeds its plan by less than the words of the rows that equal the one at its cut.
    """
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, of which the first may be shorter, and their places in sequences of 1024.

    Null and empty texts are one piece of the end mark alone.  Repeated rows are packed as
    often as they occur, and rows without an id like any other.
    """
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

#: Language inference and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
