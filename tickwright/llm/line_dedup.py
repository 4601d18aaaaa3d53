"""Line deduplication by a suffix array over line ids, in DataFrame functions only.

Every document is a sequence of line ids.  Distributed prefix doubling ranks the suffixes by
their first 1, 2, 4, ... lines: the rank of a window of 2h lines is the rank, in a range sort,
of the pair of ranks of its two halves.  A window that occurs once can't be part of a repeated
run and is left out of later rounds, so each round works on less.

A repeated run counts from ``min_words`` words on (a line without words weighs one).  The
shortest qualifying prefix of a suffix depends on its own lines only, so suffixes that share
it are one interval of the suffix array whose common prefix is at least that long, and the
interval's first suffix in document order is the original.  The same holds for the shortest
qualifying window before each line.  Any qualifying repeated run is the union of such windows,
so deleting all but the first of every interval deletes exactly the later copies of all
maximal repeated runs.  The array is sorted to the depth that these windows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.llm.common import WORD, stage, texts

MIN_WORDS = 50
_PLACE = ["doc_id", "version", "line"]


def _version(text: str = "text"):
    return F.xxhash64(text)


def line_table(df: DataFrame) -> DataFrame:
    """(doc_id, version, line, weight, id): one row per line; ``version`` tells apart different
    texts under one id."""
    lines = texts(df).select("doc_id", _version().alias("version"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.select(
        *_PLACE, F.greatest(F.regexp_count("content", F.lit(WORD)), F.lit(1)).alias("weight"),
        F.xxhash64("content").alias("left"), F.xxhash64(F.lit("line"), "content").alias("right"))


def ranked_repeats(positions: DataFrame, label: str) -> DataFrame:
    """``positions`` whose pair (left, right) occurs more than once, with the pair's rank.

    The different pairs are range-sorted; the number of a pair's range and its place there make
    a rank that keeps the order.  The counting is merged before its shuffle.
    """
    spark = positions.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = positions.groupBy("left", "right").agg(F.count("*").alias("n")).filter("n > 1").select("left", "right")
    ranged = stage(pairs.repartitionByRange(parts, "left", "right").withColumn("range", F.spark_partition_id().cast("long")), f"{label}-pairs")
    inside = W.partitionBy("range").orderBy("left", "right")
    ranks = ranged.select("left", "right", (F.shiftleft("range", 40) + F.row_number().over(inside)).alias("rank"))
    return positions.join(ranks, ["left", "right"]).drop("left", "right")


def qualifying_windows(repeated: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, line, n): the shortest windows of repeated lines that weigh at least
    ``min_words``, from each line on and up to each line.

    As every line weighs one at least, such a window has at most ``min_words`` lines, and a
    bounded frame sees it whole.
    """
    ordered = W.partitionBy("doc_id", "version").orderBy("line")
    running = (repeated.select(*_PLACE, "weight").distinct()
               .withColumn("island", F.col("line") - F.row_number().over(ordered))
               .withColumn("through", F.sum("weight").over(ordered.rowsBetween(W.unboundedPreceding, 0))))
    island = W.partitionBy("doc_id", "version", "island").orderBy("line")
    seen = F.struct("line", "through", (F.col("through") - F.col("weight")).alias("before"))
    ahead = F.collect_list(seen).over(island.rowsBetween(0, min_words - 1))
    behind = F.collect_list(seen).over(island.rowsBetween(1 - min_words, 0))
    own = running.select("doc_id", "version", "line", "through", (F.col("through") - F.col("weight")).alias("before"),
                         ahead.alias("ahead"), behind.alias("behind"))
    last = F.array_min(F.transform(F.filter("ahead", lambda s: s.through - F.col("before") >= min_words), lambda s: s.line))
    first = F.array_max(F.transform(F.filter("behind", lambda s: F.col("through") - s.before >= min_words), lambda s: s.line))
    found = own.select("doc_id", "version", F.explode(F.array(
        F.struct(F.col("line").alias("line"), (last - F.col("line") + 1).alias("n")),
        F.struct(first.alias("line"), (F.col("line") - first + 1).alias("n")))).alias("w"))
    return found.select("doc_id", "version", "w.line", "w.n").filter(F.col("n").isNotNull()).distinct()


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, line): the lines to delete, those of later copies.

    Order is by id, version and line.  Rows with the same id and text count as one document.
    """
    lines = stage(line_table(df), "lines")
    level = stage(ranked_repeats(lines, "line"), "rank-1")
    windows = stage(qualifying_windows(level, min_words), "windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    named, depth = [], 1
    ranks = level.select(*_PLACE, "rank")
    while depth <= longest:
        due = windows.filter((F.col("n") >= depth) & (F.col("n") < 2 * depth))
        second = ranks.select("doc_id", "version", (F.col("line") + depth).alias("end"), F.col("rank").alias("second"))
        named.append(due.withColumn("end", F.col("line") + F.col("n"))
                     .join(ranks, _same(due, ranks, _PLACE)).select(due.doc_id, due.version, due.line, "n", "end", F.col("rank").alias("first"))
                     .join(second.withColumnsRenamed({"doc_id": "d2", "version": "v2", "end": "e2"}),
                           F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("version") == F.col("v2")) & (F.col("end") == F.col("e2")))
                     .select(*_PLACE, "n", "first", "second"))
        if 2 * depth > longest:
            break
        after = ranks.select(F.col("doc_id").alias("d2"), F.col("version").alias("v2"), (F.col("line") - depth).alias("l2"), F.col("rank").alias("right"))
        pairs = (ranks.join(after, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("version") == F.col("v2")) & (F.col("line") == F.col("l2")))
                 .select(*_PLACE, F.col("rank").alias("left"), "right"))
        depth *= 2
        ranks = stage(ranked_repeats(pairs, f"rank-{depth}"), f"rank-{depth}")
    if not named:
        return windows.select(*_PLACE)
    members = named[0]
    for more in named[1:]:
        members = members.unionByName(more)
    members = stage(members, "interval-members")
    place = F.struct(*_PLACE)
    intervals = members.groupBy("n", "first", "second").agg(F.min(place).alias("original"), F.max(place).alias("latest")).filter("original < latest")
    copies = members.join(intervals, ["n", "first", "second"]).filter(place > F.col("original"))
    return (copies.select("doc_id", "version", F.explode(F.sequence("line", F.col("line") + F.col("n").cast("int") - 1)).alias("line"))
            .distinct())


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``df`` with ``kept_text``, ``n_lines`` and ``removed`` (array of line numbers from 0).

    A null text stays null and has no lines; an empty text is one empty line and stays.  Of
    equal runs the one that comes first by id stays; a row that repeats id and text gets the
    same result as the first.  Other columns pass through.
    """
    removed = (repeated_lines(df, min_words).groupBy("doc_id", "version")
               .agg(F.sort_array(F.collect_list("line")).alias("__removed"))
               .select(F.col("doc_id").alias("__doc_id"), F.col("version").alias("__version"), "__removed"))
    joined = (df.withColumn("__key", F.struct(F.col("doc_id").cast("long").alias("doc_id"),
                                              F.xxhash64(F.coalesce("text", F.lit(""))).alias("version")))
              .join(removed, F.col("__key.doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__key.version") == F.col("__version")), "left"))
    flags = F.flatten(F.transform("__removed", lambda line, k: F.concat(
        F.array_repeat(F.lit(False), line - F.coalesce(F.get("__removed", k - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    flagged = joined.withColumn("__flags", flags).withColumn("__lines", F.split("text", "\n"))
    kept = F.array_join(F.filter("__lines", lambda _, at: ~F.coalesce(F.get("__flags", at), F.lit(False))), "\n")
    return (flagged.withColumn("kept_text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept))
            .withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0)))
            .withColumn("removed", F.coalesce("__removed", F.array().cast("array<int>")))
            .select(*df.columns, "kept_text", "n_lines", "removed"))
