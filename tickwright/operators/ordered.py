"""Looking back along one long series without sorting it in one task.

A window over a whole series puts that series into a single task.  Here each series is cut
into chunks by its integer row order.  Rows look back inside their chunk; a small table with
one row per chunk says what the chunk inherits from the chunks before it.  The order column
is unique within a series, so a chunk holds at most ``2**CHUNK_BITS`` rows however the data
is distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.session import stage_table

CHUNK_BITS = 12
LEVELS = 2
SERIES_KEY = "__series"
#: So many series' starts are broadcast; more are joined as Spark sees fit.
MOST_STARTS = 100_000


def with_chunk(df: DataFrame, ordinal: str, bits: int = CHUNK_BITS, name: str = "__chunk") -> DataFrame:
    return df.withColumn(name, F.shiftright(F.col(ordinal).cast("long"), bits))


def with_series(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """Add the series as one column that is never NULL: a series without a name is one like any
    other, and windows, groups and joins on it need one exchange between them."""
    return df.withColumn(SERIES_KEY, F.struct(*series) if series else F.lit(0))


def inherit_last(tails: DataFrame, chunk: str, values: Sequence[str],
                 bits: int = CHUNK_BITS, levels: int = LEVELS) -> DataFrame:
    """Replace each value by the last non-null one of the chunks before, per series.

    ``tails`` has one row per (series key, chunk).  One level is a window over all chunks of a
    series; each further level groups the chunks again by ``2**bits`` first.  Two levels leave
    one row per 16 million ordinals for the last window, a few ten thousand rows for a series
    of a trillion.  Order columns that are far from dense can take a third.
    """
    if levels <= 1:
        before = W.partitionBy(SERIES_KEY).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
        inherited = {v: F.last(v, ignorenulls=True).over(before) for v in values}
        return tails.select(SERIES_KEY, chunk, *[c.alias(v) for v, c in inherited.items()])
    near = {v: f"__near_{v}" for v in values}
    looked = _look_back(tails, {near[v]: F.col(v) for v in values}, chunk, bits, levels - 1)
    return looked.select(SERIES_KEY, chunk, *[F.col(near[v]).alias(v) for v in values])


def join_series(rows: DataFrame, other: DataFrame, series: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Left join on the series and further keys; a NULL series is a series like any other."""
    renamed = with_series(other, series).drop(*series)
    return with_series(rows, series).join(renamed, [SERIES_KEY, *keys], "left").select(*rows.columns, *[
        c for c in other.columns if c not in (*series, *keys)])


def look_back(df: DataFrame, values: dict[str, Column], series: Sequence[str], ordinal: str,
              bits: int = CHUNK_BITS, levels: int = LEVELS, initial: DataFrame | None = None) -> DataFrame:
    """Add for each ``name: value`` the last non-null value on an earlier row of the series.

    ``initial`` holds values from before the first row (columns: series and the names); it
    joins the chunk table as chunk -1 and is how a stream hands over its state.

    The rows are exchanged once, by (series, chunk): the join with the chunk table uses the
    partitioning and order that the window has made.
    """
    keyed = with_series(initial, series) if initial is not None else None
    return _look_back(with_series(df, series), values, ordinal, bits, levels, keyed).drop(SERIES_KEY)


def _look_back(df: DataFrame, values: dict[str, Column], ordinal: str, bits: int, levels: int,
               initial: DataFrame | None = None) -> DataFrame:
    chunk, held = f"__chunk_{ordinal}", {name: f"__value_{name}" for name in values}
    rows = with_chunk(df, ordinal, bits, chunk).withColumns({held[n]: c for n, c in values.items()})

    before = W.partitionBy(SERIES_KEY, chunk).orderBy(ordinal).rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumns({n: F.last(held[n], ignorenulls=True).over(before) for n in values})

    def last_in_chunk(name: str) -> Column:
        filled = F.when(F.col(held[name]).isNotNull(), F.col(ordinal))
        return F.max_by(F.col(held[name]), filled).alias(held[name])

    tails = rows.groupBy(SERIES_KEY, chunk).agg(*[last_in_chunk(n) for n in values])
    if initial is not None:
        start = initial.select(SERIES_KEY, F.lit(-1).cast("long").alias(chunk),
                               *[F.col(n).alias(held[n]) for n in values])
        tails = tails.unionByName(start)
    inherited = inherit_last(tails, chunk, list(held.values()), bits, levels)
    inherited = inherited.withColumnsRenamed({held[n]: f"__from_{n}" for n in values})
    joined = near.join(inherited, [SERIES_KEY, chunk], "left")
    filled = {n: F.coalesce(F.col(n), F.col(f"__from_{n}")) for n in values}
    return joined.withColumns(filled).select(*[c for c in df.columns if c not in values], *values)


def previous_row(df: DataFrame, values: dict[str, str], series: Sequence[str], ordinal: str,
                 bits: int = CHUNK_BITS, levels: int = LEVELS) -> DataFrame:
    """Add ``name: column`` values of the row just before, NULLs included.

    Needs the first row of each chunk only: every other row takes its plain lag.
    """
    return _previous_row(with_series(df, series), values, ordinal, bits, levels).drop(SERIES_KEY)


def _previous_row(df: DataFrame, values: dict[str, str], ordinal: str, bits: int, levels: int) -> DataFrame:
    chunk = f"__chunk_{ordinal}"
    rows = with_chunk(df, ordinal, bits, chunk)
    inside = W.partitionBy(SERIES_KEY, chunk).orderBy(ordinal)
    near = rows.withColumns({n: F.lag(c).over(inside) for n, c in values.items()})
    near = near.withColumn("__first", F.row_number().over(inside) == 1)
    last = {n: F.max_by(F.col(c), F.col(ordinal)).alias(f"__last_{n}") for n, c in values.items()}
    tails = rows.groupBy(SERIES_KEY, chunk).agg(*last.values())
    if levels <= 1:
        by_chunk = W.partitionBy(SERIES_KEY).orderBy(chunk)
        carried = tails.select(SERIES_KEY, chunk, *[
            F.lag(f"__last_{n}").over(by_chunk).alias(f"__from_{n}") for n in values])
    else:
        carried = _previous_row(tails, {f"__from_{n}": f"__last_{n}" for n in values}, chunk, bits, levels - 1)
        carried = carried.select(SERIES_KEY, chunk, *[f"__from_{n}" for n in values])
    joined = near.join(carried, [SERIES_KEY, chunk], "left")
    filled = {n: F.when(F.col("__first"), F.col(f"__from_{n}")).otherwise(F.col(n)) for n in values}
    return joined.withColumns(filled).select(*[c for c in df.columns if c not in values], *values)


def sorted_positions(df: DataFrame, order: Sequence[str], name: str = "row_index",
                     series: Sequence[str] = (), file: str | None = None) -> DataFrame:
    """Row number from 0 in the order of ``order`` (a total order), per series if given.

    A range-partitioned sort splits any hot key because the order columns are unique.  The
    sorted rows are staged as parquet, whose reader knows each row's position in its file;
    adding the number of rows in earlier files gives the position overall.  The offset table
    has one row per sort partition, a number the session configuration bounds.  A series
    begins at the smallest place that one of its files counts for it; with up to
    ``MOST_STARTS`` series these starts are broadcast and no row moves again.

    ``file`` names a further column: the number of the sorted file that the row is in, by which
    :func:`in_files` writes rows in order without sorting them by range again.
    """
    staged = stage_table(df.orderBy(*series, *order), "sorted")
    rows = staged.select(
        "*",
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    key = [SERIES_KEY] if series else []
    rows = with_series(rows, series) if series else rows
    parts = rows.groupBy("__file", *key).agg(F.count("*").alias("__n"), F.min("__row").alias("__low"))
    parts = stage_table(parts, "sorted-parts") if series else parts
    earlier = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.groupBy("__file").agg(F.sum("__n").alias("__n")).select(
        "__file", (F.row_number().over(W.orderBy("__file")) - 1).alias("__place"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    placed = rows.join(F.broadcast(offsets), "__file").withColumn(name, F.col("__offset") + F.col("__row"))
    if series:
        begun = parts.join(F.broadcast(offsets), "__file").groupBy(SERIES_KEY).agg(F.min(F.col("__offset") + F.col("__low")).alias("__start"))
        begun = stage_table(begun, "series-starts")
        begun = F.broadcast(begun) if begun.limit(MOST_STARTS + 1).count() <= MOST_STARTS else begun
        placed = placed.join(begun, SERIES_KEY).withColumn(name, F.col(name) - F.col("__start"))
    return placed.select(name, *([F.col("__place").alias(file)] if file else []), *df.columns)


def in_files(df: DataFrame, order: str, file: str) -> DataFrame:
    """Rows in the files that ``file`` numbers, each in the order of ``order``; the columns that
    say so are there still.  Rows go to the task of their number: no sampling, no range sort."""
    files = df.agg(F.max(file)).first()[0]
    return df.repartitionById(1 + (files or 0), F.col(file)).sortWithinPartitions(order)
