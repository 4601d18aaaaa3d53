"""Exact percentiles of many columns, also where no task can hold a column's values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.functions.cells import any_of, nan_to_null
from tickwright.functions.names import named
from tickwright.operators.wide import batches

# Distinct values of one bracket that a single sort may hold at the end.
MAX_OPEN_VALUES = 1_000_000
SKETCH_ACCURACY = 5_000


@dataclass
class _Bracket:
    """Where two neighbouring ranks of one column lie.

    ``below`` values are smaller than ``lo``, ``at_lo`` equal it, ``open`` lie strictly
    between, ``at_hi`` equal ``hi``; no ``lo`` or ``hi`` means no bound on that side.
    Values that repeat massively end up on a bound.
    """

    column: str
    first: int
    second: int
    fraction: float
    open: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    at_lo: int = 0
    at_hi: int = 0
    widen: float = 1.0

    def known(self, rank: int) -> float | None:
        if rank < self.below + self.at_lo:
            return self.lo
        if rank >= self.below + self.at_lo + self.open:
            return self.hi
        return None

    @property
    def solved(self) -> bool:
        return self.known(self.first) is not None and self.known(self.second) is not None


def numeric_column(name: str) -> Column:
    """Double form in which NaN counts as missing."""
    return nan_to_null(named(name).cast("double"))


def exact_percentiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float],
                      max_open_values: int = MAX_OPEN_VALUES,
                      accuracy: int = SKETCH_ACCURACY) -> dict[str, list[float | None]]:
    """Percentiles by linear interpolation at ``p * (n - 1)``, missing values left out.

    The built-in exact percentile keeps every distinct value of a column in one task, so it
    is not used.  An approximate percentile gives a bracket around each wanted rank, a count
    says how many values lie below, on and inside it, and both repeat until few values are
    inside, which are then ranked exactly.  A bracket that missed its rank is seen in the
    counts and widened.  Each step is a partial aggregate over a scan of these columns; only
    the values of the last brackets are shuffled.  A billion rows take one round, three scans.
    """
    short = {c: f"v{i}" for i, c in enumerate(dict.fromkeys(columns))}
    if not short:
        return {}
    data = df.select(*[numeric_column(c).alias(v) for c, v in short.items()])
    columns = list(short.values())
    brackets, ends = _first_brackets(data, columns, fractions, accuracy)
    pending = list(brackets.values())
    if pending:
        _recount(data, pending, ends)
    while pending := [b for b in pending if not b.solved and b.open > max_open_values]:
        _recount(data, pending, _narrower(data, pending, accuracy))
    ranked = _rank_open(data, [b for b in brackets.values() if not b.solved])

    def value(key: tuple[str, float]) -> float | None:
        if key not in brackets:
            return None
        b = brackets[key]
        low, high = (ranked[key_rank] if (key_rank := (id(b), rank)) in ranked else b.known(rank)
                     for rank in (b.first, b.second))
        return low * (1 - b.fraction) + high * b.fraction

    return {c: [value((v, p)) for p in fractions] for c, v in short.items()}


def _first_brackets(data: DataFrame, columns: Sequence[str], fractions: Sequence[float], accuracy: int):
    """Counts and the first approximate ends of all columns, in one scan."""
    margin = 2.0 / accuracy
    probes = [x for p in fractions for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    brackets: dict[tuple[str, float], _Bracket] = {}
    ends: list[tuple[float, float]] = []
    for batch in batches(columns):
        row = data.agg(*[
            F.struct(F.count(c).alias("n"), F.percentile_approx(c, F.lit(probes), accuracy).alias("at")).alias(c)
            for c in batch
        ]).first()
        for c in batch:
            n, at = row[c]
            for i, p in enumerate(fractions):
                if n and (c, p) not in brackets:
                    place = p * (n - 1)
                    first = math.floor(place)
                    brackets[c, p] = _Bracket(c, first, min(first + 1, n - 1), place - first, n)
                    ends.append((at[2 * i], at[2 * i + 1]))
    return brackets, ends


def _inside(b: _Bracket) -> Column:
    inside = F.col(b.column).isNotNull()
    if b.lo is not None:
        inside = inside & (F.col(b.column) > b.lo)
    if b.hi is not None:
        inside = inside & (F.col(b.column) < b.hi)
    return inside


def _narrower(data: DataFrame, pending: list[_Bracket], accuracy: int) -> list[tuple[float | None, float | None]]:
    """Approximate ends, safely outside the wanted ranks; a known end stays as it is."""
    ends: list[tuple[float | None, float | None]] = []
    for batch in batches(pending):
        sketches = []
        for i, b in enumerate(batch):
            margin = 2.0 * b.widen / accuracy
            at = [(r - b.below - b.at_lo) / max(b.open - 1, 1) for r in (b.first, b.second)]
            probe = F.lit([min(max(at[0] - margin, 0.0), 1.0), max(min(at[1] + margin, 1.0), 0.0)])
            sketches.append(F.percentile_approx(F.when(_inside(b), F.col(b.column)), probe, accuracy).alias(f"b{i}"))
        row = data.agg(*sketches).first()
        for i, b in enumerate(batch):
            lo, hi = row[f"b{i}"]
            ends.append((b.lo if b.known(b.first) is not None else lo,
                         b.hi if b.known(b.second) is not None else hi))
    return ends


def _recount(data: DataFrame, brackets: list[_Bracket], ends: Sequence[tuple]) -> None:
    """Count against new ends and take them, unless they missed a wanted rank."""
    for batch, new in zip(batches(brackets), batches(ends), strict=True):
        counts = []
        for i, (b, (lo, hi)) in enumerate(zip(batch, new, strict=True)):
            v = F.col(b.column)
            counts += [
                F.count_if(v < lo).alias(f"below{i}"), F.count_if(v == lo).alias(f"lo{i}"),
                F.count_if((v > lo) & (v < hi)).alias(f"open{i}"),
                F.count_if((v == hi) & F.lit(hi > lo)).alias(f"hi{i}"),
            ]
        row = data.agg(*counts).first()
        for i, (b, (lo, hi)) in enumerate(zip(batch, new, strict=True)):
            below, at_lo, inside, at_hi = (row[f"{k}{i}"] for k in ("below", "lo", "open", "hi"))
            if below <= b.first and b.second < below + at_lo + inside + at_hi:
                b.lo, b.hi, b.below, b.at_lo, b.open, b.at_hi = lo, hi, below, at_lo, inside, at_hi
                b.widen = 1.0
            else:
                b.widen *= 4


def _rank_open(data: DataFrame, brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks of brackets that are small enough to sort.

    Equal values are counted together first; the window then holds at most
    ``max_open_values`` distinct values of one bracket.
    """
    if not brackets:
        return {}

    def counted_values(batch: Sequence[tuple[int, _Bracket]]) -> DataFrame:
        inside = data.filter(any_of([_inside(b) for _, b in batch])).select(*[
            F.when(_inside(b), F.col(b.column)).alias(str(i)) for i, b in batch])
        long = inside.unpivot([], inside.columns, "i", "v").filter("v IS NOT NULL")
        return long.groupBy("i", "v").agg(F.count("*").alias("n"))

    counted = reduce(DataFrame.unionAll, [counted_values(b) for b in batches(list(enumerate(brackets)))])
    wanted = data.sparkSession.createDataFrame(
        [(str(i), rank, rank - b.below - b.at_lo) for i, b in enumerate(brackets)
         for rank in sorted({b.first, b.second}) if b.known(rank) is None],
        "i string, rank long, place long")
    upto = counted.withColumn("upto", F.sum("n").over(W.partitionBy("i").orderBy("v")))
    hits = (
        upto.join(F.broadcast(wanted), "i")
        .filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        .select("i", "rank", "v").collect()
    )
    return {(id(brackets[int(hit["i"])]), hit["rank"]): hit["v"] for hit in hits}
