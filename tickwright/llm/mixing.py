"""Mixing sources to target weights: random order inside each source, cut at a word budget.

Every document gets a key from a hash of its id.  The high bits of the key cut a source into
ranges of about equal size however large the source is, so a source with a third of all rows
is as many ranges as it needs.  A range is sorted in one task, running sums inside the ranges
and over the ranges' totals give each document's exact place in its source's word order, and
the budget cuts there.  A budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.llm.common import WORD, block_bits, broadcast_if_small, stage

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
ROWS_PER_RANGE = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_key(doc_id: Column, seed: str) -> Column:
    """Hash-random key: 32 hex digits, the same in every run."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[float], most_epochs: float) -> DataFrame:
    """One row per source: its size, its target and the words to take.

    Filling up by weight with upper limits has a closed form: with sources ordered by limit
    over weight, a source is full if its limit does not exceed its share of what the full ones
    before it leave.  The windows run over one row per source.
    """
    ranked = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    filling = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    per_source = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * float(most_epochs))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("left", F.col("total") - F.coalesce(
            F.sum("most").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("full", F.col("most") * F.col("weights") <= F.col("left") * F.col("weight"))
        .withColumn("level", F.first(F.when(~F.col("full"), F.struct("left", "weights")), ignorenulls=True)
                    .over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("target", F.when(F.col("full"), F.col("most"))
                    .otherwise(F.col("level.left") * F.col("weight") / F.col("level.weights")))
        .withColumn("budget", F.round("target").cast("long"))
    )
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    return per_source.select("source", "source_size", "target", "budget", whole.alias("epochs"),
                             (F.col("budget") - whole * F.col("source_size")).alias("rest"))


def mixing_plan(df: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: float = MOST_EPOCHS,
                seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per document of ``df`` (doc_id, source, text): ``size`` in words, its source's
    ``source_size`` and ``target``, ``epochs`` it is taken whole, ``last_words`` taken of it in
    the last, cut epoch, and ``taken`` words in all.

    Null texts have no words, a null source is a source of its own and comes last, equal keys
    are ordered by id and size (rows that repeat in all three can stand for each other), an
    empty table gives no rows, other columns are ignored.
    """
    sizes = stage(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                            word_count(F.col("text")).alias("size"))
                  .withColumn("mix_key", mix_key(F.col("doc_id"), seed)), "mix-sizes")
    bits = block_bits(sizes.count(), rows_per_range)
    head = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long")
    ranged = sizes.withColumn("range", F.shiftright(head, 32 - bits)).withColumn("source", F.struct("source"))
    inside = W.partitionBy("source", "range").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranges_before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = (ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
              .select("source", "range", F.coalesce(F.sum("words").over(ranges_before), F.lit(0)).alias("start")))
    targets = source_targets(sizes, weights, most_epochs).withColumn("source", F.struct("source"))
    placed = (ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, ["source", "range"]).join(targets, "source")
              .withColumn("before", F.col("start") + F.col("inside")))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return (placed.withColumn("last_words", last)
            .select("doc_id", F.col("source.source").alias("source"), "mix_key", "size", "source_size", "target",
                    "epochs", "rest", "before", "last_words",
                    (F.col("epochs") * F.col("size") + F.col("last_words")).alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, gaps between words as they are."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n), "")


def mix_documents(df: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: float = MOST_EPOCHS,
                  seed: str = "mix") -> DataFrame:
    """The mixed rows themselves, with the columns of ``df``: a document once for each epoch
    that takes it, and the one that crosses its source's budget cut to its first words.

    Each source's cut is one place in its order, so one row per source says what to take and
    texts are not shuffled.  A document without words is taken as its place in the order says.
    Rows equal in source, id and size are taken alike: where the cut falls on such a row, all of
    them are cut at its place, so the source's words exceed the plan by less than those rows hold.
    """
    plan = stage(mixing_plan(df, weights, most_epochs, seed), "mix-plan")
    reached = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))
    cuts = broadcast_if_small(
        plan.groupBy(F.struct("source").alias("__source"))
        .agg(F.first("epochs").alias("__epochs"),
             F.min(F.when(reached, F.struct("mix_key", "doc_id", "size", "last_words"))).alias("__cut")), "mix-cuts")
    own = F.struct(mix_key(F.col("doc_id"), seed).alias("mix_key"), F.col("doc_id").cast("long").alias("doc_id"),
                   word_count(F.col("text")).alias("size"))
    cut = F.struct("__cut.mix_key", "__cut.doc_id", "__cut.size")
    columns = df.columns
    joined = (df.withColumn("__source", F.struct(F.col("source").cast("string").alias("source")))
              .join(cuts, "__source")
              .withColumn("__own", own))
    last = (F.when(F.col("__cut").isNull() | (F.col("__own") > cut), F.lit(0).cast("long"))
            .when(F.col("__own") < cut, F.col("__own.size")).otherwise(F.col("__cut.last_words")))
    has_last = F.col("__cut").isNotNull() & (F.col("__own") <= cut)
    copies = F.concat(
        F.array_repeat(F.col("__own.size"), F.col("__epochs").cast("int")),
        F.when(has_last, F.array(last)).otherwise(F.array().cast("array<bigint>")))
    taken = joined.withColumn("__words", F.explode(copies))
    text = F.when(F.col("__words") < F.col("__own.size"), first_words(F.col("text"), F.col("__words").cast("int"))).otherwise(F.col("text"))
    return taken.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) \
        if "n_chars" in columns else taken.withColumn("text", text).select(*columns)
