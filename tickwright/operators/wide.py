"""Statistics of many columns as rows, one per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns per aggregate: more make generated code too long to compile.
BATCH = 12


def batches(items: Sequence, size: int = BATCH) -> list[Sequence]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def per_column(df: DataFrame, entries: Sequence[Column], series: Sequence[str] = ()) -> DataFrame:
    """Rows (series, fields of the entry) from aggregate structs, one entry per column.

    Aggregates wide, so that no row is copied per column before it is merged.  Batches read
    disjoint columns, so a columnar source is still read once overall.
    """

    def long(batch: Sequence[Column]) -> DataFrame:
        wide = df.groupBy(*series).agg(*[e.alias(f"_{i}") for i, e in enumerate(batch)])
        return wide.select(*series, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(batch))])))

    return reduce(DataFrame.unionAll, [long(batch) for batch in batches(entries)])
