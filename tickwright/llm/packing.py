"""Packing token sequences: bounded-space online best fit.

Texts become token ids in tasks; what travels on is a few numbers per piece.  Pieces that fill
a sequence need no packing.  The others go by a hash of their document to packing tasks of
about ``pieces_per_task``, each with a fixed number of open bins in a bitset over free space:
best fit is the lowest set bit at or above a piece's length.  If no bin fits and all are open,
the fullest closes first.  A task takes its pieces longest first, which makes best fit nearly
perfect while its bins are not fewer than its long pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm import bpe
from tickwright.llm.common import in_batches, stage, texts, with_package

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 1 << 16
PIECES_PER_TASK = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most ``most`` open bins over free space 0..capacity, found through one bitset.

    ``by_free[f]`` holds the numbers of the open bins with ``f`` free places; bit ``f`` is set
    while there is one.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:  # close the fullest
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:  # a full bin closes by itself
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of ``n`` ids, all of ``capacity`` but the first."""
    cuts = range(n % capacity or capacity, n, capacity)
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def token_pieces(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of (doc_id, text): ids of the text, then ``end_id``, cut into pieces
    of ``capacity`` if longer (the first may be shorter); null and empty texts are the end id."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = bpe.ids_bytes(text, vocabulary) + end
            for piece, (start, stop) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                                         names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_batches(texts(df), cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
                pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence exceeds ``capacity``.

    Rows in a packing task are ordered by length, id and piece, so that a task that runs again
    packs alike.  Repeated rows are packed each; an empty table gives no rows.
    """
    full = pieces.filter(F.col("length") >= capacity)
    rest = pieces.filter(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // pieces_per_task))
    whole = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    dealt = (rest.withColumn("task", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(tasks)))
             .repartition(tasks, "task").sortWithinPartitions("task", F.desc("length"), "doc_id", "piece", "ids_crc32"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, bins = None, None
        for frame in frames:
            numbers, offsets = [], []
            for own, length in zip(frame.pop("task").tolist(), frame["length"].tolist(), strict=True):
                if own != task:
                    task, bins = own, OpenBins(capacity, open_bins)
                number, offset = bins.place(length)
                numbers.append((number * tasks + task) * 2)
                offsets.append(offset)
            yield frame.assign(sequence_id=pd.Series(numbers, index=frame.index, dtype="int64"),
                               offset=pd.Series(offsets, index=frame.index, dtype="int64"))

    packed = with_package(dealt).mapInPandas(pack, f"{PIECES}, sequence_id long, offset long")
    return packed.unionByName(whole)


def pack_documents(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Tokenise, cut and pack (doc_id, text); other columns are ignored."""
    pieces = stage(token_pieces(df, vocabulary, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity, open_bins, pieces_per_task)
