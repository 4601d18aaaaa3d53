"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is halved again and again into equal parts, and the means of the last parts
are the lists' centroids.  Vectors go to their nearest list and, near a boundary, to each
further list whose distance is within a ratio of the nearest.  A query looks at the lists
within a ratio of its own nearest centroid.  Both find centroids by a beam search in a graph
of neighbouring centroids that every task holds in memory.

Vectors of one list meet the queries that chose it in blocks of bounded size, whatever a
list's size: a list with very many equal vectors is many blocks.  Scores are inner products of
the original vectors in double precision; all rows are in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.llm.common import broadcast_if_small, stage, with_package

NEIGHBOURS = 20
#: Rows per list aimed at, most lists, and sampled rows per list (both bound the driver's work).
LIST_ROWS, MOST_LISTS, SAMPLE_PER_LIST = 256, 4096, 24
#: Distance ratios and largest numbers of lists for vectors and for queries.
VECTOR_RATIO, VECTOR_LISTS = 1.1, 4
QUERY_RATIO, QUERY_LISTS = 1.35, 48
BLOCK_ROWS = 4096
DEGREE, BEAM = 16, 64


def participating(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that can take part: not null, not zero, all
    components finite."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite & F.exists("embedding", lambda x: x != 0))


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` parts of nearly equal size, by halving the largest part along the
    direction between two far apart means."""
    random = np.random.default_rng(7)
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        points = sample[own]
        left, right = points[random.choice(len(own), 2, replace=False)]
        for _ in range(6):
            along = points @ (right - left)
            order = np.argsort(along, kind="stable")
            half = len(own) // 2
            left, right = points[order[:half]].mean(axis=0), points[order[half:]].mean(axis=0)
        parts += [own[order[:half]], own[order[half:]]]
    return np.stack([sample[part].mean(axis=0) for part in parts])


@dataclass
class CentroidGraph:
    """Centroids, each with its ``DEGREE`` nearest and two random others as neighbours."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        k, random = len(centroids), np.random.default_rng(11)
        degree = min(DEGREE, k - 1)
        squares = (centroids ** 2).sum(axis=1)
        near = np.empty((k, degree), dtype=np.int64)
        for at in range(0, k, 512):
            distance = squares[None, :] - 2 * centroids[at:at + 512] @ centroids.T
            near[at:at + 512] = np.argsort(distance, axis=1, kind="stable")[:, 1:degree + 1]
        far = random.integers(0, k, size=(k, 2))
        entries = random.choice(k, size=min(k, max(8, int(np.sqrt(k)))), replace=False)
        return cls(centroids, np.hstack([near, far]), np.sort(entries))

    def search(self, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each point the ``beam`` nearest centroids found and their distances, nearest
        first; missing ones are -1 at infinity."""
        n, k = len(points), len(self.centroids)
        beam = min(beam, k)
        seen = np.zeros((n, k), dtype=bool)
        rows = np.arange(n)[:, None]
        squares = (self.centroids ** 2).sum(axis=1)
        own = (points ** 2).sum(axis=1)

        def distances(found: np.ndarray) -> np.ndarray:
            products = np.einsum("nd,nmd->nm", points, self.centroids[found])
            return np.sqrt(np.maximum(own[:, None] + squares[found] - 2 * products, 0))

        found = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        distance = distances(found)
        seen[rows, found] = True
        best, far = self._top(found, distance, beam)
        expanded = np.zeros((n, k), dtype=bool)
        while True:
            open_ = np.where((best >= 0) & ~expanded[rows, np.maximum(best, 0)], far, np.inf)
            front = np.argsort(open_, axis=1, kind="stable")[:, :4]
            live = np.isfinite(open_[rows, front])
            if not live.any():
                return best, far
            picked = np.where(live, best[rows, front], best[:, :1])
            expanded[rows, picked] = True
            found = self.neighbours[picked].reshape(n, -1)
            distance = np.where(seen[rows, found], np.inf, distances(found))
            # the same centroid may be found twice in one step
            order = np.argsort(found, axis=1, kind="stable")
            found, distance = np.take_along_axis(found, order, 1), np.take_along_axis(distance, order, 1)
            distance[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf
            seen[rows, found] = True
            best, far = self._top(np.hstack([best, found]), np.hstack([far, distance]), beam)

    @staticmethod
    def _top(found: np.ndarray, distance: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(distance, axis=1, kind="stable")[:, :beam]
        distance = np.take_along_axis(distance, order, 1)
        return np.where(np.isfinite(distance), np.take_along_axis(found, order, 1), -1), distance


def fit_index(vectors: DataFrame, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS) -> tuple[CentroidGraph, float, int]:
    """The graph of centroids, the largest norm and the dimension (that of most vectors)."""
    shape = vectors.groupBy(F.size("embedding").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")
    ).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return CentroidGraph.build(np.zeros((1, 1))), 0.0, 0
    lists = max(1, min(most_lists, -(-shape.n // list_rows)))
    sample = (vectors.filter(F.size("embedding") == shape.d).orderBy(F.xxhash64("vec_id"), "vec_id")
              .limit(lists * SAMPLE_PER_LIST).select("embedding").toArrow())
    points = np.array(sample.column("embedding").to_pylist(), dtype=np.float64)
    return CentroidGraph.build(balanced_centroids(_lifted(points, shape.norm), lists)), shape.norm, shape.d


def _lifted(points: np.ndarray, norm: float | None) -> np.ndarray:
    """One more component that brings all vectors to the largest norm, so that the nearest by
    distance is the largest by inner product; a query (no norm) gets a zero there."""
    rest = np.zeros(len(points)) if norm is None else np.sqrt(np.maximum(norm * norm - (points ** 2).sum(axis=1), 0))
    return np.hstack([points, rest[:, None]])


def chosen_lists(vectors: DataFrame, graph: CentroidGraph, norm: float | None, ratio: float, most: int) -> DataFrame:
    """(vec_id, embedding, list): a row for each list within ``ratio`` of the nearest centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(graph)  # at most MOST_LISTS centroids

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                points = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
                best, far = shared.value.search(_lifted(points, norm), max(BEAM, most))
                taken = (best >= 0) & (far <= np.maximum(far[:, :1] * ratio, 1e-12))
                taken[:, most:] = False
                rows, places = np.nonzero(taken)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(best[rows, places], pa.int32())],
                                                 names=["vec_id", "embedding", "list"])

    return with_package(vectors).mapInArrow(choose, "vec_id long, embedding array<double>, list int")


def _block(id_col: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col(blocks)).cast("int")


def nearest(vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, list_rows: int = LIST_ROWS,
            query_ratio: float = QUERY_RATIO, query_lists: int = QUERY_LISTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``neighbours`` nearest found for each query among all
    rows but its own; nearest first, ties to the smaller id.

    Where a query's lists hold fewer others than that, it is asked of all lists, so every query
    gets ``neighbours`` rows, or all other vectors if there are fewer.  Vectors that are null,
    zero or hold null or non-finite components, and those of another dimension than most, take
    no part.  Rows that repeat an id count once; an empty table gives no rows; other columns are
    ignored.
    """
    taking = stage(participating(vectors), "vectors")
    graph, norm, dimension = fit_index(taking, list_rows)
    own = taking.filter(F.size("embedding") == dimension)
    postings = stage(chosen_lists(own, graph, norm, VECTOR_RATIO, VECTOR_LISTS), "postings")
    queries = own.filter(is_query)
    probes = chosen_lists(queries, graph, None, query_ratio, query_lists).withColumnRenamed("vec_id", "query_id")
    found = stage(_asked(stage(probes, "probes"), postings, neighbours, block_rows), "found")
    least = min(neighbours, own.select("vec_id").distinct().count() - 1)
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    short = stage(queries.join(counts, "vec_id", "left").filter(F.coalesce("n", F.lit(0)) < least).drop("n"), "short-queries")
    if short.limit(1).count() == 0:
        return found
    lists = F.explode(F.sequence(F.lit(0), F.lit(len(graph.centroids) - 1))).alias("list")
    everywhere = stage(short.select(F.col("vec_id").alias("query_id"), "embedding", lists), "short-probes")
    refilled = _asked(everywhere, postings, neighbours, block_rows)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(refilled)


def _asked(probes: DataFrame, postings: DataFrame, neighbours: int, block_rows: int) -> DataFrame:
    """The nearest of each query in the lists that its probes name."""
    sizes = broadcast_if_small(
        postings.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        .join(probes.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("query_blocks")), "list"), "lists")
    blocked = (postings.join(sizes, "list").withColumn("block", _block("vec_id", "blocks"))
               .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks").cast("int") - 1))).drop("blocks", "query_blocks"))
    asking = (probes.join(sizes, "list").withColumn("query_block", _block("query_id", "query_blocks"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).drop("blocks", "query_blocks"))
    keys = ["list", "block", "query_block"]

    def meet(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(found):
            ids = found["vec_id"].to_numpy()
            points = np.stack(found["embedding"].to_numpy())
            for at in range(0, len(queries), 256):
                part = queries.iloc[at:at + 256]
                asked, own_ids = np.stack(part["embedding"].to_numpy()), part["query_id"].to_numpy()
                products = asked @ points.T
                products[own_ids[:, None] == ids] = -np.inf
                kth = np.partition(products, max(0, len(ids) - neighbours), axis=1)[:, max(0, len(ids) - neighbours)]
                floor = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))), -np.inf)
                for row in range(len(part)):
                    near = np.flatnonzero((products[row] >= floor[row]) & np.isfinite(products[row]))
                    exact = (points[near] * asked[row]).sum(axis=1)  # the same for equal vectors
                    order = np.lexsort((ids[near], -exact))[:neighbours]
                    out.append((np.full(len(order), own_ids[row]), ids[near][order], exact[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    met = (asking.groupBy(*keys).cogroup(blocked.groupBy(*keys))
           .applyInPandas(meet, "query_id long, vec_id long, score double"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= neighbours)
            .select("query_id", "rank", "vec_id", "score"))
