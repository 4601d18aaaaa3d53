"""Delimited sensor files as text cells, with each row's place in the files."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.config import SeriesConfig
from tickwright.functions.cells import may_need_strip, strip
from tickwright.functions.names import BYTE_ORDER_MARK, HeaderField, header_mapping
from tickwright.functions.times import parse_time
from tickwright.operators.ordered import look_back
from tickwright.session import stage_table

ORDINAL = "_ordinal"
MISMATCH = "flag_row_length_mismatch"
TIME = "_ts"
_CORRUPT = "_corrupt"
# Quotes inside quoted cells are doubled; the corrupt column marks short and long rows.
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
            "maxCharsPerColumn": "-1", "maxColumns": "100000"}
# monotonically_increasing_id() numbers the records of a task in its low 33 bits.
_RECORD_BITS = 33
_SPLIT = ["_file", "_block"]
# A whole quoted cell, and a quote that opens one.
_QUOTED_CELL = r'(^|,)"(?:[^"]++|"")*+"[^,]*+'
_OPENING = r'(^|,)"'
# A cell longer than this is an unclosed quote, not data.
_LONGEST_CELL = 131_072
_UNCLOSED = f"a quoted cell is not closed within {_LONGEST_CELL} characters"
# Starts of so many splits are broadcast, some 100 MB; 100 TB in splits of 128 MB have 800,000.
_MOST_SPLITS = 4_000_000
# Up to so many rows, a sample's lines are taken by the driver, which stops the scan early.
_DRIVER_SAMPLE = 100_000


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every line with its file, the start of its split and its number in the reading task."""
    record = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _RECORD_BITS) - 1))
    return spark.read.text(path if isinstance(path, str) else list(path)).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        record.alias("_record"))


def _split_keys(splits: DataFrame) -> tuple[Column, DataFrame]:
    """A 64-bit number for each split, and the splits with it.  No two have the same one: if
    two hashes agree, the next seed is taken."""
    total, seed = splits.count(), 0
    while True:
        key = F.xxhash64(F.lit(seed), *_SPLIT)
        if splits.select(key.alias("_key")).distinct().count() == total:
            return key, splits.withColumn("_key", key)
        seed += 1


def _place_rows(staged: DataFrame, header_lines: bool) -> DataFrame:
    """Number staged lines from 0 over files by name, splits and lines; drop header lines.

    A split's records are numbered one after another, so a row's place is its distance from the
    split's first record plus the rows of all earlier splits.  That holds for splits of any
    size and for tasks that read several.  The table of splits has one row per split, which is
    a few numbers under a 64-bit key: up to ``_MOST_SPLITS`` of them are broadcast and the rows
    stay where they are.
    """
    splits = staged.groupBy(*_SPLIT).agg(F.min("_record").alias("_first"), F.count("*").alias("_n"))
    splits = stage_table(splits, "splits")
    key, keyed = _split_keys(splits)
    earlier = W.orderBy(*_SPLIT).rowsBetween(W.unboundedPreceding, -1)
    of_file = W.partitionBy("_file").orderBy("_block")
    starts = keyed.select("_key", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
                          F.when(F.row_number().over(of_file) == 1, F.col("_first")).alias("_head"))
    starts = stage_table(starts, "split-starts")
    starts = F.broadcast(starts) if starts.limit(_MOST_SPLITS + 1).count() <= _MOST_SPLITS else starts
    placed = staged.withColumn("_key", key).join(starts, "_key")
    if header_lines:
        placed = placed.filter(F.col("_head").isNull() | (F.col("_record") > F.col("_head")))
    return placed.withColumn(ORDINAL, F.col("_shift") + F.col("_record")).drop("_key", "_block", "_record", "_shift", "_head")


def _ends_inside(line: Column) -> Column:
    """Does a line that begins outside quotes end inside a quoted cell?"""
    return line.contains('"') & F.regexp_replace(line, _QUOTED_CELL, "$1").rlike(_OPENING)


def _joined_lines(placed: DataFrame, cells: int) -> DataFrame:
    """Put lines together whose quoted cell goes on in the next line.

    A line maps "begins inside quotes" to "ends inside quotes": it keeps it, flips it, or sets
    it.  Where a line begins is the last setting before it and the number of flips since, and
    both are look-backs.  No record is put together that is longer than ``cells`` cells of the
    greatest length may be.
    """
    outside = _ends_inside(F.col("value"))
    inside = F.when(F.col("value").contains('"'), _ends_inside(F.concat(F.lit('"'), F.col("value")))).otherwise(F.lit(True))
    mapped = stage_table(placed.select("_file", ORDINAL, "value", outside.alias("_out"), inside.alias("_in")), "quoted-lines")
    sets = F.when(F.col("_out") == F.col("_in"), F.struct(F.col(ORDINAL).alias("at"), F.col("_out").alias("open")))
    seen = look_back(mapped, {"_set": sets}, ["_file"], ORDINAL)
    flips = (seen.filter("_out AND NOT _in")
             .withColumn("_flips", F.row_number().over(W.partitionBy("_file", "_set.at").orderBy(ORDINAL)))
             .select(ORDINAL, F.struct(F.col("_set.at").alias("at"), F.col("_flips").alias("n")).alias("_flip")))
    flipped = look_back(seen.join(flips, ORDINAL, "left"), {"_last": F.col("_flip")}, ["_file"], ORDINAL)
    count = F.when(F.col("_last.at").eqNullSafe(F.col("_set.at")) & F.col("_last").isNotNull(), F.col("_last.n")).otherwise(F.lit(0))
    begins_inside = F.coalesce(F.col("_set.open"), F.lit(False)) != (count % 2 == 1)
    started = stage_table(flipped.select("_file", ORDINAL, "value", begins_inside.alias("_inside")), "line-starts")
    begun = look_back(started, {"_begun": F.when(~F.col("_inside"), F.col(ORDINAL))}, ["_file"], ORDINAL)
    rows = begun.withColumn("_begun", F.when(F.col("_inside"), F.coalesce("_begun", ORDINAL)).otherwise(F.col(ORDINAL)))
    lengths = rows.groupBy("_begun").agg(F.count("*").alias("_n"), F.sum(F.length("value") + 1).alias("_length")).filter("_n > 1")
    if lengths.filter(F.col("_length") > cells * (_LONGEST_CELL + 3)).limit(1).count():
        raise ValueError(_UNCLOSED)
    whole = (rows.join(lengths.select("_begun"), "_begun", "left_semi").groupBy("_file", "_begun")
             .agg(F.sort_array(F.collect_list(F.struct(ORDINAL, "value"))).alias("_parts"))
             .select("_file", F.col("_begun").alias(ORDINAL), F.array_join(F.col("_parts.value"), "\n").alias("value")))
    single = rows.join(lengths.select("_begun"), "_begun", "left_anti").select("_file", ORDINAL, "value")
    return single.unionByName(whole)


def _drop_first(rows: DataFrame) -> DataFrame:
    """Without the first record of each file, of which there is one row."""
    heads = rows.groupBy("_file").agg(F.min(ORDINAL).alias("_head"))
    return rows.join(heads, "_file").filter(F.col(ORDINAL) > F.col("_head")).drop("_head")


def _files(spark: SparkSession, path: str | Sequence[str]) -> Iterator[str]:
    """Paths by name, a few at a time; their contents are not read."""
    listed = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path")
    return (row.path for row in listed.orderBy("path").toLocalIterator())


def _first_lines(spark: SparkSession, file: str, records: int) -> list[str]:
    """The lines that hold the first ``records`` records of a file.  Taking lines reads the
    first splits alone."""
    wanted = records
    while True:
        lines = [row.value for row in spark.read.text(file).take(wanted)]
        reader = csv.reader(line + "\n" for line in lines)
        found = 0
        while found < records and next(reader, None) is not None:
            found += 1
        if len(lines) < wanted:
            return lines[:reader.line_num] if found == records else lines
        if found == records and reader.line_num < wanted:
            return lines[:reader.line_num]
        if found == records and reader.line_num == wanted and not _open_at_end(lines):
            return lines
        wanted *= 2


def _open_at_end(lines: Sequence[str]) -> bool:
    """Would the last record go on in the next line?"""
    return list(csv.reader([*(line + "\n" for line in lines), '"'])) == list(csv.reader(line + "\n" for line in lines))


def read_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Header cells of the first file that has any; cells may hold line breaks."""
    for file in _files(spark, path):
        lines = _first_lines(spark, file, 1)
        if lines:
            lines[0] = lines[0].removeprefix(BYTE_ORDER_MARK)
            return next(csv.reader(line + "\n" for line in lines), [])
    raise ValueError(f"no header line in {path}")


def _sample_lines(spark: SparkSession, path: str | Sequence[str], rows: int, header_lines: bool) -> DataFrame:
    """The lines of the first ``rows`` records, as :func:`_lines` gives them."""
    taken: list[tuple[str, str, int, int]] = []
    left = rows
    for number, file in enumerate(_files(spark, path)):
        lines = _first_lines(spark, file, left + header_lines)
        taken += [(value, f"{number:09d}", 0, at) for at, value in enumerate(lines)]
        left -= max(0, sum(1 for _ in csv.reader(line + "\n" for line in lines)) - header_lines)
        if left <= 0:
            break
    return spark.createDataFrame(taken, "value string, _file string, _block long, _record long")


def read_cells(spark: SparkSession, path: str | Sequence[str], headers: Sequence[str] | None = None,
               row_limit: int | None = None, time: tuple[str, str] | None = None,
               trim: bool = True) -> tuple[DataFrame, list[str]]:
    """Every cell as text, trimmed unless ``trim`` is off: columns ``c0..``, the ordinal and the
    row-length flag.

    Short rows are padded with blanks, long rows cut.  Blank lines stay rows, quoted cells may
    hold line breaks, and large files are split; files in which no quote stays open at a line's
    end, which is seen while cells are staged, are never gone through again.  With ``headers``
    given, the files have no header line.  ``row_limit`` keeps the first rows and reads no
    further than needed.  ``time`` (header, format) adds the parsed time as ``_ts``.

    Record numbers belong to one planning of the scan, so cells are staged once with them,
    trimmed and parsed; later steps read single columns of that table instead of whole lines.
    """
    names = list(headers) if headers is not None else read_header(spark, path)
    fields = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{f} string" for f in [*fields, _CORRUPT])
    header_lines = headers is None
    if row_limit is not None and row_limit <= _DRIVER_SAMPLE:
        lines = stage_table(_sample_lines(spark, path, row_limit, header_lines), "sample-lines")
    else:
        lines = _lines(spark, path)

    def parsed(rows: DataFrame) -> DataFrame:
        split = rows.withColumn("_cells", F.from_csv("value", F.lit(schema), _OPTIONS))
        # The parser leaves the corrupt column empty for a line without any text.
        mismatch = F.col(f"_cells.{_CORRUPT}").isNotNull() | (F.col("value") == "")
        whole = F.array(*[F.coalesce(f"_cells.{f}", F.lit("")) for f in fields])
        texts = F.when(may_need_strip(F.col("value")), F.transform(whole, strip)).otherwise(whole) if trim else whole
        # No cell is longer than its line.
        long = F.exists(whole, lambda cell: F.length(cell) > _LONGEST_CELL) if fields else F.lit(False)
        long = F.when(F.length("value") > _LONGEST_CELL, long).otherwise(F.lit(False))
        kept = [c for c in rows.columns if c != "value"]
        shaped = split.select(*kept, texts.alias("_texts"), mismatch.alias(MISMATCH), _ends_inside(F.col("value")).alias("_opens"), long.alias("_long"))
        when = [parse_time(F.col("_texts")[names.index(time[0])], time[1]).alias(TIME)] if time and time[0] in names else []
        return shaped.select(*kept, *[F.col("_texts")[i].alias(f) for i, f in enumerate(fields)], MISMATCH, "_opens", "_long", *when)

    staged = stage_table(parsed(lines), "cells")
    opens, long = staged.agg(F.max("_opens"), F.max("_long")).first()
    if opens:
        whole = _joined_lines(_place_rows(stage_table(lines, "lines"), False), len(fields) + 1)
        rows = stage_table(parsed(_drop_first(whole) if header_lines else whole), "cells")
        long = rows.agg(F.max("_long")).first()[0]
    else:
        rows = _place_rows(staged, header_lines)
    if long:
        raise ValueError(_UNCLOSED)
    cells = rows.select(ORDINAL, *fields, MISMATCH, *([TIME] if TIME in rows.columns else []))
    return (first_rows(cells, row_limit) if row_limit is not None else cells), names


def repair_row_shape(df: DataFrame, cells: str, width: int) -> DataFrame:
    """Pad or cut an array of cells to ``width`` and flag rows that needed it."""
    padded = F.concat(F.col(cells), F.array_repeat(F.lit(""), width))
    return df.withColumns({
        MISMATCH: F.size(cells) != width,
        cells: F.slice(padded, 1, width),
    })


def read_series(spark: SparkSession, config: SeriesConfig, path: str | Sequence[str] | None = None,
                headers: Sequence[str] | None = None,
                row_limit: int | None = None) -> tuple[DataFrame, list[HeaderField]]:
    """One configured series: trimmed cells under clean names, and the header mapping.

    The time cell is called ``time_raw``, its parsed form ``_ts``.  ``row_limit`` keeps the
    first rows in file order.
    """
    cells, names = read_cells(spark, path or config.path, headers, row_limit, ("Time", config.time_format))
    mapping = header_mapping(names, config)
    renamed = [F.col(f"c{i}").alias("time_raw" if field.role == "time" else field.clean) for i, field in enumerate(mapping)]
    return cells.select(F.lit(config.name).alias("source_dataset"), ORDINAL, TIME, *renamed, MISMATCH), mapping


def read_named(spark: SparkSession, path: str | Sequence[str], row_limit: int | None = None, trim: bool = True) -> DataFrame:
    """Cells under the file's own headers, with the ordinal; blank lines are left out.

    A header without text is called ``Unnamed: <place>``, a repeated one ``<name>.<count>``.
    """
    cells, names = read_cells(spark, path, None, row_limit, trim=trim)
    given: dict[str, int] = {}
    columns = []
    for i, name in enumerate(names):
        name = name if name.strip() else f"Unnamed: {i}"
        columns.append(f"{name}.{given[name]}" if name in given else name)
        given[name] = given.get(name, 0) + 1
    blank = F.col(MISMATCH) & F.forall(F.array(*[f"c{i}" for i in range(len(names))]), lambda c: c == "")
    return cells.filter(~blank).select(ORDINAL, *[F.col(f"c{i}").alias(name) for i, name in enumerate(columns)])


def first_rows(df: DataFrame, n: int = 1000, ordinal: str = ORDINAL) -> DataFrame:
    """The first ``n`` rows in file order."""
    return df.orderBy(ordinal).limit(n)
