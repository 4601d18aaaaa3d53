"""Connected components of a link table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm.common import stage, with_package

#: Links that a task joins at a time before the rounds.
CHUNK = 1 << 17
#: Tables of a round have about so many links a file, in so many files at least.  A file costs
#: processes of its own where it is made, so that many small ones take more than their rows do.
LINKS_A_FILE, LEAST_FILES = 100_000, 8


def _stars(links: pa.Table) -> pa.RecordBatch:
    """Links of each node to the smallest that it reaches by these links, which join the same."""
    nodes, ends = np.unique(np.concatenate([links.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            break
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (ahead := label[label])[label != ahead].size:
            label = ahead
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]]), pa.array(nodes[moved])], names=["a", "b"])


def _contracted(links: DataFrame) -> DataFrame:
    """Links that join the same nodes, no more than nodes for every ``CHUNK`` of a task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK:
                yield _stars(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield _stars(pa.Table.from_batches(held))

    return with_package(links).mapInArrow(run, "a long, b long")


def _roots(step: DataFrame, files: int) -> DataFrame:
    """Follow labels to the end, two steps a time; each is the smaller end of a link, so the
    ways end."""
    while True:
        ahead = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        further = step.select(F.col("id").alias("next"), F.col("label").alias("last"))
        jumped = step.join(ahead, "label").join(further, "next").select("id", F.col("label").alias("old"), F.col("last").alias("label"))
        jumped = stage(jumped.coalesce(files), "labels")
        if jumped.filter("label < old").limit(1).count() == 0:
            return jumped.select("id", "label")
        step = jumped.select("id", "label")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over ``links`` (a, b); ids without links don't occur.

    First each task joins what its own links join, a bounded number at a time, and gives stars
    around the smallest ids.  Then, each round, a node takes its smallest neighbour's label and
    then that label's end, so every tree of such steps becomes one node, and only links between
    different nodes go on: later rounds are over fewer and fewer links.  Every round is a written
    table; the driver sees only how many links are left.
    """
    ordered = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links, labels = stage(_contracted(stage(ordered, "links")), "links"), None
    left = links.count()
    if not left:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    while True:
        files = LEAST_FILES + left // LINKS_A_FILE
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("label"))
        step = _roots(stage(step.coalesce(files), "labels"), files)
        if labels is None:
            labels, all_files = step, files
        else:
            moved = step.select(F.col("id").alias("label"), F.col("label").alias("root"))
            labels = stage(labels.join(moved, "label", "left").select("id", F.coalesce("root", "label").alias("label")).coalesce(all_files), "labels")
        one, other = (step.select(F.col("id").alias(end), F.col("label").alias(f"{end}_root")) for end in ("a", "b"))
        apart = (links.join(one, "a").join(other, "b").filter("a_root <> b_root")
                 .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")))
        links = stage(apart.distinct().coalesce(files), "links")
        left = links.count()
        if not left:
            return labels
