"""Similarity self-join on word n-grams: signature trees over the documents that can have a link.

All shingles are put in one order, that of their hashes.  Two sets that are similar enough share
some of the first shingles of either, since without all of these too little would be left to
share.  So each document gives only the head of its set.  A document of whose head too little
occurs elsewhere is linked with nothing and goes no further; the others come into one group with
those that share one of the rarer shingles.  Heads are compared first,
and what can be similar by them is compared whole.  Both is done by signature trees: nodes with OR-combined bitmaps and size ranges, two trees gone through
together, pairs of nodes left aside by their largest possible overlap (``signature_tree.py``).
Large groups are cut into cells by size, the upper level of the trees, which Spark compares in
pairs (``groups.py``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm.common import broadcast_if_small, stage
from tickwright.llm.groups import BLOCK_ROWS, BLOCK_SHINGLES, grouped_links
from tickwright.llm.minhash import classes_of, components_of, sets_of, signatures
from tickwright.session import Staged

SHINGLE, PERCENT = 4, 85


#: Shingles of a head beyond those that must hold one in common, in percent of the set.
MORE = 10
_SIGN = np.uint64(1 << 63)


def first_count(n: int, percent: int) -> int:
    """So many shingles of a set of ``n`` hold one that every similar enough set has too."""
    return n - (percent * n + 99) // 100 + 1


def head(own: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in order and ``MORE`` percent that follow, as signed numbers in the
    same order."""
    return (own[:first_count(len(own), percent) + MORE * len(own) // 100] ^ _SIGN).view(np.int64)


def head_entries(signed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(row, key, n, weight): the rarer shingles in the head of each class that can have a link,
    of which each class that it is linked with has one among its own.

    Of the heads of two similar sets take the one that ends first in the order.  Its set has
    ``needed`` shingles less 1 and ``MORE`` percent after it, and the sets have ``needed`` in
    common, so the heads have 1 and ``MORE`` percent in common, which is ``least``.  The other
    set may be the smaller one, but it is no smaller than ``needed``.  So each may leave aside
    all but one of ``least`` of its shingles, and leaves the most frequent: the rarest one that
    two similar sets have in common stays with both.

    A row's weight is how often the shingles of its head occur on average: in a group of copies
    it is largest for the text that most of the others were made from.
    """
    # Rows whose set another row stands for take no part.
    copies = signed.select("row", "set_high", "set_low").join(classes.select("set_high", "set_low", F.col("row").alias("own")), ["set_high", "set_low"])
    copies = broadcast_if_small(copies.filter("row <> own").select("row"), "copies", 500_000)
    single = signed.join(copies, "row", "left_anti").select("row", F.explode("marks").alias("key"))
    often = single.groupBy("key").agg(F.count("*").cast("int").alias("times")).filter("times > 1")
    shared = single.join(often, "key").groupBy("row").agg(F.collect_list(F.struct("times", "key")).alias("shared"))
    needed = f"(({percent} * n_shingles + 99) DIV 100)"
    sized = signed.select("row", F.col("n_shingles").alias("n"), F.expr(f"1 + {MORE} * {needed} DIV 100").cast("int").alias("least"))
    found = shared.join(sized, "row").filter(F.size("shared") >= F.col("least"))
    keys = F.slice(F.array_sort("shared"), F.lit(1), F.size("shared") - F.col("least") + 1)
    weight = F.aggregate("shared", F.lit(0.0), lambda total, one: total + one["times"]) / F.size("shared")
    return found.select("row", "n", weight.alias("weight"), F.explode(keys["key"]).alias("key"))


def ngram_join(df: DataFrame, width: int = SHINGLE, percent: int = PERCENT,
               block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text).

    Two documents link if ``100 * shared >= percent * united`` different shingles; with fewer
    than ``width`` words all of them are one shingle.  Null texts and texts without words are
    linked with nothing.  ``component_id`` is the smallest id reachable by links; texts that
    share an id are linked each by its own words, and rows that repeat id and text come out as
    often.  A row without an id takes part; it has a null component only where no row with an
    id is reachable.  Other columns are ignored.
    """
    with Staged(df.sparkSession) as between:
        signed = signatures(df, width, lambda own: head(own, percent))
        classes = classes_of(signed)
        heads = signed.select("row", F.col("marks").alias("shingles"))
        links = grouped_links(
            head_entries(signed, classes, percent), classes, lambda wanted: sets_of(df, wanted, width), percent, block_shingles, block_rows,
            lambda wanted: heads.join(broadcast_if_small(wanted, "wanted", 500_000), "row"), MORE)
        found = stage(components_of(signed, classes, links), "ngram-join")
        between.take_last()
    return found
