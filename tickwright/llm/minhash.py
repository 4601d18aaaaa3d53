"""Near-duplicate documents: MinHash with tensored banding, every link verified on full sets.

Two collections of ``side`` short minhash tuples are computed.  A table's key is a pair of one
tuple from each, so ``side * side`` tables cost only ``2 * side`` tuples.  Documents that share
a key are candidates: they have a tuple of either collection in common.  Keys are formed only of
tuples that another document has too, so a document that is like no other forms hardly any.

Documents with equal shingle sets are merged before anything else.  Candidates are verified on
full sets in groups around the most typical document of each table's bucket (``groups.py``): no
bucket is capped, no candidate pair that could join two components is left out, and a bucket of
near copies never becomes pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm.bpe import Memory
from tickwright.llm.common import broadcast_if_small, in_batches, stage, texts
from tickwright.llm.components import connected_components
from tickwright.llm.groups import BLOCK_ROWS, BLOCK_SHINGLES, grouped_links
from tickwright.session import Staged

SHINGLE, PERCENT = 2, 80
#: Tuples per collection and minhashes per tuple: 256 tables of 6 minhashes each from 96.
SIDE, TUPLE = 16, 3
#: Factors of the mixing functions, odd and fixed.
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_BLOCK = 1 << 15

_words = Memory(xxhash.xxh3_64_intdigest)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C3
    return x ^ (x >> np.uint64(27))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the different ``width``-word shingles; letters A-Z count as a-z.  With
    fewer words all of them are one shingle, without words there is none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    mixed = np.full(len(words) - width + 1, np.uint64(width), dtype=np.uint64)
    for at in range(width):
        mixed = _mix(mixed * _C1 + hashes[at:len(words) - width + 1 + at] * _C2)
    return np.unique(mixed)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_000_003)
    numbers = random.integers(1, 1 << 63, size=(2, count), dtype=np.uint64)
    return numbers[0] * np.uint64(2) + np.uint64(1), numbers[1]


def minhash_tuples(shingles: np.ndarray, count: int, length: int) -> np.ndarray:
    """``count`` tuples of ``length`` minhashes, each tuple hashed to one number."""
    factors, shifts = _factors(count * length)
    least = np.full(count * length, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        block = shingles[at:at + _BLOCK, None] * factors + shifts
        np.minimum(least, block.min(axis=0), out=least)
    keys = np.full(count, np.uint64(length), dtype=np.uint64)
    for part in least.reshape(count, length).T:
        keys = _mix(keys * _C1 + part * _C2)
    return keys.view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(own) for own in sets])))
    joined = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(joined))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Both halves of each set's 128-bit digest."""
    digests = b"".join(hashlib.blake2b(own.tobytes(), digest_size=16).digest() for own in sets)
    return [pa.array(half) for half in np.frombuffer(digests, dtype=np.int64).reshape(-1, 2).T]


def signatures(df: DataFrame, width: int, marks: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, n_shingles, set_high, set_low, marks, row): the size and digest of the set, what
    ``marks`` makes of it, and a number of the row.  Written, since the numbers belong to one run."""

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(text, width) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(own) for own in sets], pa.int64()), *_digests(sets), _lists([marks(own) for own in sets])],
            names=["doc_id", "n_shingles", "set_high", "set_low", "marks"])

    signed = in_batches(texts(df), sign, "doc_id long, n_shingles long, set_high long, set_low long, marks array<long>")
    return stage(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")


def sets_of(df: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted classes (id, set_high, set_low, ...) with their ``shingles``, from the texts of
    documents that have their ids."""

    def shingles(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(text, width) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*_digests(sets), _lists(sets)], names=["set_high", "set_low", "shingles"])

    wanted = broadcast_if_small(wanted, "wanted", 500_000)
    own = wanted.select(F.col("id").alias("own_id")).distinct()
    found = texts(df).join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")
    # Where no id repeats, each class is found once.
    repeated = found.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    shaped = in_batches(found, shingles, "set_high long, set_low long, shingles array<long>")
    shaped = shaped.dropDuplicates(["set_high", "set_low"]) if repeated else shaped
    return shaped.join(wanted, ["set_high", "set_low"])


def classes_of(signed: DataFrame) -> DataFrame:
    """(set_high, set_low, row, id): a row for each set that isn't empty, one row that has it
    and the smallest id that has it."""
    filled = signed.filter("n_shingles > 0").groupBy("set_high", "set_low")
    return stage(filled.agg(F.min("row").alias("row"), F.min("doc_id").alias("id")), "classes")


def components_of(signed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row, given links between class rows."""
    labelled = (classes.join(connected_components(links).withColumnRenamed("id", "row"), "row", "left")
                .withColumn("label", F.coalesce("label", "row")))
    least = labelled.groupBy("label").agg(F.min("id").alias("component"))
    kinds = labelled.join(least, "label").select("set_high", "set_low", "component")
    joined = signed.drop("marks", "row").join(kinds, ["set_high", "set_low"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def bucket_entries(signed: DataFrame, classes: DataFrame, side: int) -> DataFrame:
    """(row, key, n, weight): the table keys of each class whose both tuples another class has.

    A row's weight counts how often its tuples occur: in a group of copies it is largest for
    the text that most of the others were made from.
    """
    rows = signed.join(classes.select("row"), "row", "left_semi")
    tuples = stage(rows.select("row", F.col("n_shingles").alias("n"), "marks"), "tuples")
    # A tuple's number goes into its hash, so equal tuples have equal numbers.
    single = tuples.select("row", F.explode(F.transform("marks", lambda value, at: F.xxhash64(value, at).bitwiseAND(F.lit(-2)) + F.when(at < side, 0).otherwise(1))).alias("tuple"))
    often = single.groupBy("tuple").agg(F.count("*").cast("int").alias("times")).filter("times > 1")
    shared = single.join(often, "tuple").groupBy("row").agg(F.collect_list("tuple").alias("shared"), F.sum("times").alias("weight"))
    one, other = (F.filter("shared", lambda t: t.bitwiseAND(F.lit(1)) == 0), F.filter("shared", lambda t: t.bitwiseAND(F.lit(1)) == 1))
    keys = F.flatten(F.transform(one, lambda u: F.transform(other, lambda v: F.xxhash64(u, v))))
    return shared.join(tuples.select("row", "n"), "row").select("row", "n", "weight", F.explode(keys).alias("key"))


def near_duplicates(df: DataFrame, width: int = SHINGLE, percent: int = PERCENT, side: int = SIDE, length: int = TUPLE,
                    block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    Two documents are linked if ``100 * shared >= percent * united`` shingles.  Null texts and
    texts without words are linked with nothing.  ``component_id`` is the smallest id reachable;
    a row is kept if that is its own id, so rows that repeat an id and a kept text are all kept.
    Texts that share an id are linked each by its own words.  A row without an id takes part and
    is kept only where no row with an id is reachable.  Other columns are ignored.
    """
    with Staged(df.sparkSession) as between:
        signed = signatures(df, width, lambda own: minhash_tuples(own, 2 * side, length))
        classes = classes_of(signed)
        links = grouped_links(bucket_entries(signed, classes, side), classes, lambda wanted: sets_of(df, wanted, width),
                              percent, block_shingles, block_rows)
        found = stage(components_of(signed, classes, links), "near-duplicates")
        between.take_last()
    component = F.col("component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id").eqNullSafe(component), F.lit(False)))
