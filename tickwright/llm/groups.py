"""Links among rows that share keys, without pairs of all rows that share one.

Each key has a leader, the most typical of its rows, so that rows which share many keys mostly
share a leader too.  All rows that share a key with a leader are its group.  Two rows that share
a key are in the group of that key's leader, so groups hold every candidate pair.

Groups that overlap are put together as far as they make one block, in which links are found
exactly; there each row comes once.  Of what is larger, rows whose whole sets are there are put
together anew, by the shingles that are rare among them (:func:`_rarer_members`): a row that
shares none of its own with another is linked with nothing.  What is still larger than a block
goes group by group, and a large group as follows.  Every row is compared with the leader first.  Then the group is cut into cells
by size, by distance from the leader and at random, none larger than a block, and cells are
compared in pairs: not those that sizes or the triangle inequality of the Jaccard distance keep
apart, and not those whose rows are all linked to the leader already, which is most of a large
group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm.common import broadcast_if_small, stage, with_package
from tickwright.llm.components import connected_components
from tickwright.llm.signature_tree import Rule, forest

#: A block has at most about so many shingles and rows.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 18, 2048
#: Distances from the leader are told apart by so much.
DISTANCE_BANDS = 20


def _links_of_blocks(blocks: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """(a, b) found in each block of (keys, row, n, label, side, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        rows, n, label, side = (table.column(c).to_numpy() for c in ("row", "n", "label", "side"))
        pairs = forest(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), label.copy(), side, rule, n)
        ends = [sorted((int(rows[a]), int(rows[b]))) for a, b in pairs]
        return pa.table({"a": pa.array([a for a, _ in ends], pa.int64()), "b": pa.array([b for _, b in ends], pa.int64())})

    columns = [*keys, "row", "n", "label", "side", "shingles"]
    return with_package(blocks.select(*columns)).groupBy(*keys).applyInArrow(run, "a long, b long")


def grouped_links(entries: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int,
                  block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS,
                  heads_of: Callable[[DataFrame], DataFrame] | None = None, more: int = 0) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs that share a key.

    ``entries``: (row, key, n, weight) with the set's size and how typical the row is, the same
    for all keys of a row.  ``classes``: (row, ...), with sets that are unlike and not empty.
    ``sets_of`` gives the rows it is given with their ``shingles``.  ``heads_of`` does so with
    heads of the sets; then these are compared first, and only rows whose heads have enough in
    common (``more``, see :class:`Rule`) come into one block with their whole sets.
    """
    members, clusters = _members_of(entries)
    if heads_of is not None:
        possible = _links_in(members, clusters, classes, heads_of, Rule(percent, more), block_shingles, block_rows)
        clusters = connected_components(possible)
    return _links_in(members, clusters, classes, sets_of, Rule(percent), block_shingles, block_rows)


def _members_of(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leader, row, n) of the groups, and (id, label) of the groups that overlap."""
    entries = stage(entries.select("row", "key", "n", "weight"), "entries")
    leaders = (entries.groupBy("key").agg(F.max(F.struct("weight", "row")).alias("top"), F.count("*").alias("rows"))
               .filter("rows > 1").select("key", F.col("top.row").alias("leader")))
    members = stage(entries.join(leaders, "key").select("leader", "row", "n").distinct(), "members")
    return members, connected_components(members.select(F.col("leader").alias("a"), F.col("row").alias("b")))


def _rarer_members(large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups among the rows of large clusters (row, n, cluster), by their rarest shingles there.

    Let all shingles of a cluster be in one order, the rarest first.  A set has ``needed``
    shingles in common with any that is similar enough, so the first of these in the order is
    among the first ``n - needed + 1`` of both sets.  Shingles that no other row of the cluster
    has come first and need no group.  Near copies that differ in many places have enough of
    their own to come into none; the pairs of a large cluster are never gone through for that.
    """
    single = large.select("row", "n", "cluster").join(sets, "row").select("cluster", "row", "n", F.explode("shingles").alias("shingle"))
    often = single.groupBy("cluster", "shingle").agg(F.count("*").cast("int").alias("times")).filter("times > 1")
    shared = (single.join(often, ["cluster", "shingle"]).groupBy("cluster", "row", "n")
              .agg(F.collect_list(F.struct("times", "shingle")).alias("shared")))
    first = F.expr(f"cast(n - ({percent} * n + 99) DIV 100 + 1 - (n - size(shared)) as int)")
    weight = F.aggregate("shared", F.lit(0.0), lambda total, one: total + one["times"]) / F.size("shared")
    kept = shared.withColumn("first", first).filter("first > 0")
    keys = F.slice(F.array_sort("shared"), F.lit(1), F.col("first"))["shingle"]
    entries = kept.select("cluster", "row", "n", weight.alias("weight"), F.explode(keys).alias("shingle"))
    return _members_of(entries.select("row", F.xxhash64("cluster", "shingle").alias("key"), "n", "weight"))


def _links_in(members: DataFrame, clusters: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame],
              rule: Rule, block_shingles: int, block_rows: int, rarer: bool = False) -> DataFrame:
    """Links between rows that are in one group and one cluster.  Small clusters are a block.
    Where whole sets are given, rows of large ones come into new groups first, unless the groups
    are those already (``rarer``)."""
    near = members.select("row", "n").distinct().join(clusters.select(F.col("id").alias("row"), F.col("label").alias("cluster")), "row")
    is_large = (F.sum("n") > block_shingles) | (F.count("*") > block_rows)
    sizes = near.groupBy("cluster").agg(is_large.alias("large"))
    wanted = stage(near.join(sizes, "cluster").select("row", "n", "cluster", "large").join(classes, "row"), "wanted")
    alone = {"label": F.col("row"), "side": F.lit(0)}
    links = stage(_links_of_blocks(sets_of(wanted.filter("NOT large")).withColumns(alone), ["cluster"], rule), "links")
    large = wanted.filter("large")
    if large.limit(1).count() == 0:
        return links
    sets = stage(sets_of(large).select("row", "shingles"), "sets")
    if rule.more is None and not rarer:
        members, clusters = _rarer_members(large, sets, rule.percent)
        return links.unionByName(_links_in(
            members, clusters, classes, lambda wanted: sets.join(broadcast_if_small(wanted, "wanted", 500_000), "row"),
            rule, block_shingles, block_rows, True))
    groups = members.join(large.select("row", "cluster"), "row").select(F.xxhash64("leader", "cluster").alias("group"), "leader", "row", "n")
    is_large = (F.sum("n") > block_shingles) | (F.count("*") > block_rows)
    # The leader itself may be in another cluster.
    hub = F.coalesce(F.max(F.when(F.col("leader") == F.col("row"), F.col("row"))), F.min("row"))
    size = groups.groupBy("group").agg(is_large.alias("large"), hub.alias("hub"), F.count("*").alias("rows")).filter("rows > 1")
    sized = stage(groups.drop("leader").join(size.drop("rows"), "group"), "sized-members")
    links = stage(_links_of_blocks(sized.filter("NOT large").join(sets, "row").withColumns(alone), ["group"], rule), "links").unionByName(links)
    large = sized.filter("large").drop("large")
    if large.limit(1).count() == 0:
        return links
    return links.unionByName(_links_of_large(large, sets, links, rule, block_shingles, block_rows))


def _links_of_large(members: DataFrame, sets: DataFrame, links: DataFrame, rule: Rule,
                    block_shingles: int, block_rows: int) -> DataFrame:
    """Links in groups (group, hub, row, n) that are larger than a block."""
    percent = rule.percent
    leading = sets.select(F.col("row").alias("hub"), F.col("shingles").alias("leading"))
    sizes = members.filter("row = hub").select("group", F.col("n").alias("n_hub"))
    counted = (members.join(sets, "row").join(leading, "hub").join(sizes, "group")
               .select("group", "hub", "row", "n", "n_hub", F.size(F.array_intersect("shingles", "leading")).cast("long").alias("shared")))
    small, big = F.least("n", "n_hub"), F.greatest("n", "n_hub")
    if rule.more is None:
        united = F.col("n") + F.col("n_hub") - F.col("shared")
        near, distance = 100 * F.col("shared") >= percent * united, 1 - F.col("shared") / united
    else:  # heads tell nothing of the distance
        needed = F.floor((percent * small + 99) / 100)
        near = (100 * small >= percent * big) & (F.col("shared") >= 1 + F.floor(rule.more * needed / 100))
        distance = F.lit(0.0)
    counted = stage(counted.select("group", "hub", "row", "n", near.alias("near"), distance.alias("distance")), "distances")
    first = (counted.filter("near AND row <> hub")
             .select(F.least("hub", "row").alias("a"), F.greatest("hub", "row").alias("b")).distinct())
    first = stage(first, "hub-links")
    labels = connected_components(first.unionByName(links))
    of_hub = labels.select(F.col("id").alias("hub"), F.col("label").alias("hub_label"))
    labelled = (counted.join(labels.withColumnRenamed("id", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
                .join(of_hub, "hub", "left").withColumn("done", F.col("label") == F.coalesce("hub_label", "hub")))
    ratio = math.log(100 / percent) if percent < 100 else 1.0
    placed = stage(labelled.select(
        "group", "row", "n", "label", "done", F.floor(F.log("n") / ratio).cast("int").alias("size_band"),
        F.floor(F.col("distance") * DISTANCE_BANDS).cast("int").alias("distance_band")), "placed")
    bands = ["group", "done", "size_band", "distance_band"]
    shares = placed.groupBy(*bands).agg(F.greatest(
        F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_rows)).cast("int").alias("parts"))
    cells = shares.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = stage(cells.select(*bands, "part", F.xxhash64(*bands, "part").alias("cell")), "cells")
    one, other = (cells.select("group", *[F.col(c).alias(f"{c}_{at}") for c in ("cell", *bands[1:])]) for at in (1, 2))
    farthest = math.ceil(DISTANCE_BANDS * (100 - percent) / 100) + 1
    pairs = one.join(other, "group").filter(
        (F.col("cell_1") <= F.col("cell_2")) & ~(F.col("done_1") & F.col("done_2"))
        & (F.abs(F.col("size_band_1") - F.col("size_band_2")) <= 2)
        & (F.abs(F.col("distance_band_1") - F.col("distance_band_2")) <= farthest)).select("group", "cell_1", "cell_2")
    pairs = stage(pairs, "cell-pairs")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    rows = stage(placed.join(shares, bands).withColumn("part", part).select(
        "group", "row", "n", "label", F.xxhash64(*bands, "part").alias("cell")), "in-cells")
    left = pairs.withColumn("side", F.lit(1)).withColumn("cell", F.col("cell_1"))
    right = pairs.filter("cell_1 < cell_2").withColumn("side", F.lit(2)).withColumn("cell", F.col("cell_2"))
    blocks = rows.join(left.unionByName(right), ["group", "cell"]).join(sets, "row")
    return first.unionByName(_links_of_blocks(blocks, ["group", "cell_1", "cell_2"], rule))
