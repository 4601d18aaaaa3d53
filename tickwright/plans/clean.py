"""Cleaning flow: text cells to flagged rows, audit table, ML-ready table and QA summary."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.config import SeriesConfig, SeriesRegistry
from tickwright.functions.cells import as_number, encode_boolean, encode_state, flag_int, flag_text, normalize_word
from tickwright.functions.names import PUMP_STATE_FIELD, HeaderField, field_metadata, named
from tickwright.functions.times import canonical_time, parse_time
from tickwright.operators.quality import BAD_CELLS, qa_summary, with_counters
from tickwright.operators.sequence import FLAGS, flag_sequence
from tickwright.session import Staged, delete_path, stage_table
from tickwright.sources.delimited import ORDINAL, TIME, read_series
from tickwright.sources.sinks import write_by_series, write_document

NUMBERS, ROW_ORDER = "_numbers", "row_order"
_PREVIOUS = "_prev_valid_time"


def numeric_fields(mapping: Sequence[HeaderField]) -> list[str]:
    return [field.clean for field in mapping if field.role == "numeric"]


def flag_rows(cells: DataFrame, mapping: Sequence[HeaderField], config: SeriesConfig) -> DataFrame:
    """Parse time and numbers once and add all six flags; no row is dropped.

    Numbers go into one array, ``_numbers``, and the places of cells that are none into
    ``_bad_cells``, so that no output parses again and the size of the generated code does not
    grow with the number of columns.  Text cells stay as they are.  Time flags come first: only
    the text cells move for them, not the numbers made from these.
    """
    numeric = numeric_fields(mapping)
    texts = F.array(*[named(c) for c in numeric]) if numeric else F.array().cast("array<string>")
    if TIME not in cells.columns:
        cells = cells.withColumn(TIME, parse_time(F.col("time_raw"), config.time_format))
    kept = cells.columns
    seen = flag_sequence(cells, config.expected_gap_seconds, TIME, ordinal=ORDINAL, name=_PREVIOUS)
    parsed = seen.withColumn("_number_texts", texts).withColumn(NUMBERS, F.transform("_number_texts", as_number))
    missed = F.transform("_number_texts", lambda text, at: F.when((F.coalesce(text, F.lit("")) != "") & F.col(NUMBERS)[at].isNull(), at))
    bad = F.when(F.exists(NUMBERS, lambda number: number.isNull()), F.filter(missed, lambda at: at.isNotNull()))
    bad = F.coalesce(bad, F.array().cast("array<int>"))
    flagged = parsed.withColumn(BAD_CELLS, bad).withColumn("flag_non_numeric_in_numeric_field", F.size(BAD_CELLS) > 0)
    added = [NUMBERS, BAD_CELLS, "flag_non_numeric_in_numeric_field"]
    return flagged.select(*[named(c) for c in kept], *added, *[f for f in FLAGS if f not in kept and f not in added])


def audit_table(flagged: DataFrame, mapping: Sequence[HeaderField], keep: Sequence[str] = ()) -> DataFrame:
    """Everything as text, states and booleans in lower case, flags ``true``/``false``; a pump
    state is known by its name here.  ``row_order`` is the record's place in the file.  Columns
    to ``keep`` follow as they are."""

    def cell(field: HeaderField) -> Column:
        text = named(field.clean)
        word = field.role in ("boolean", "state") or field.clean == PUMP_STATE_FIELD
        return (normalize_word(text) if word else text).alias(field.clean, metadata=field_metadata(field))

    return flagged.select(
        "source_dataset", F.col(ORDINAL).alias(ROW_ORDER), "time_raw", canonical_time(F.col(TIME)).alias("time"),
        *[cell(field) for field in mapping if field.role != "time"],
        *[flag_text(F.col(f)).alias(f) for f in FLAGS], *keep,
    )


def ml_ready_table(flagged: DataFrame, mapping: Sequence[HeaderField], keep: Sequence[str] = ()) -> DataFrame:
    """Numbers as doubles, states and booleans as 1/0/NULL, flags 1/0; no raw time or index.
    ``row_order`` is the record's place in the file.  Each column's schema entry holds its
    header, role, unit and definition.  Columns to ``keep`` follow as they are."""
    place = {clean: at for at, clean in enumerate(numeric_fields(mapping))}

    def cell(field: HeaderField) -> Column:
        if field.role == "numeric":
            return F.col(NUMBERS)[place[field.clean]].alias(field.clean, metadata=field_metadata(field))
        coded = {"boolean": encode_boolean, "state": encode_state}[field.role](named(field.clean))
        return coded.alias(field.clean, metadata=field_metadata(field))

    return flagged.select(
        "source_dataset", F.col(ORDINAL).alias(ROW_ORDER), canonical_time(F.col(TIME)).alias("time"),
        *[cell(field) for field in mapping if field.role not in ("time", "index")],
        *[flag_int(F.col(f)).alias(f) for f in FLAGS], *keep,
    )


def mapping_table(spark: SparkSession, mapping: Sequence[HeaderField]) -> DataFrame:
    rows = [(i, field.source, field.clean, field.role) for i, field in enumerate(mapping)]
    return spark.createDataFrame(rows, "position int, source string, clean string, role string")


@dataclass(frozen=True)
class CleanResult:
    """Where the outputs are, and the staged flagged rows they were made from."""

    flagged: DataFrame
    mapping: list[HeaderField]
    audit_path: str
    ml_path: str
    summary_path: str
    staged: str = ""

    def release(self) -> None:
        """Delete the staged flagged rows; the written outputs stay."""
        if self.staged:
            delete_path(self.flagged.sparkSession, self.staged)


def clean_series(spark: SparkSession, config: SeriesConfig, output: str, mode: str = "sample",
                 sample_rows: int = 1000, headers: Sequence[str] | None = None,
                 fmt: str = "parquet") -> CleanResult:
    """Clean one series and write its audit table, ML-ready table and QA summary.

    Flagged rows are staged once in shared storage.  The three outputs read only the columns
    they need from there; none of them repeats the parse or the sort, and a lost executor
    costs no more than the tasks it was running.  The summary's counters are taken on the way
    to the audit table and need no scan of their own.  All staged tables but the flagged rows are
    deleted at the end, and those by ``release()`` on the result.
    """
    limit = sample_rows if mode == "sample" else None
    with Staged(spark) as between:
        cells, mapping = read_series(spark, config, headers=headers, row_limit=limit)
        flagged = stage_table(flag_rows(cells, mapping, config), f"flagged-{config.name}")
        kept = between.take_last()

    folder = f"{output}/data/{'cleaned' if mode == 'full' else mode}"
    qa_folder = f"{output}/qa" if mode == "full" else f"{output}/qa/{mode}"
    paths = (f"{folder}/{config.name}_cleaned", f"{folder}/{config.name}_ml_ready",
             f"{qa_folder}/{config.name}_summary")
    counted, counters = with_counters(flagged, TIME)
    write_by_series(audit_table(counted, mapping), paths[0], fmt)
    write_by_series(ml_ready_table(flagged, mapping), paths[1], fmt)
    pairs = F.array(*[F.struct(F.lit(f.source).alias("source"), F.lit(f.clean).alias("clean")) for f in mapping])
    summary = qa_summary(flagged, numeric_fields(mapping), TIME, ordinal=ORDINAL, counts=counters(config.name), constants={
        "mode": F.lit(mode), "row_limit": F.lit(limit).cast("int"), "input_path": F.lit(config.path),
        "output_path": F.lit(paths[0]), "ml_ready_output_path": F.lit(paths[1]), "header_mapping": pairs,
    })
    write_document(summary.withColumnRenamed("source_dataset", "dataset"), paths[2])
    return CleanResult(flagged, mapping, *paths, staged=kept)


def clean_all(spark: SparkSession, registry: SeriesRegistry, output: str, name: str = "all", at_once: int = 8,
              **options) -> dict[str, CleanResult]:
    """Clean the selected series, each with its own settings, up to ``at_once`` beside each other.

    Small series alone leave most of a cluster idle between their many short jobs; the jobs of
    several fill it.  A long series takes what tasks it needs either way.
    """
    chosen = registry.select(name)
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(chosen)))) as pool:
        results = pool.map(lambda c: clean_series(spark, c, output, **options), chosen)
        return {c.name: result for c, result in zip(chosen, results, strict=True)}
