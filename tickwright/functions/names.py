"""Header names: cleaning, uniqueness, roles, definitions and units.

Every rule exists twice: for the header list of one file (plain Python, a few names) and as
column expressions for a catalog table with one row per file and header position.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwright.config import SeriesConfig
from tickwright.functions.cells import strip

BOOLEAN_MARK = "(True/False)"
BYTE_ORDER_MARK = chr(0xFEFF)
# Names that the cleaning flow adds itself; names of its own steps begin with an underscore.
RESERVED = (
    "source_dataset", "time_raw", "row_order", "flag_bad_timestamp_format", "flag_non_monotonic_time", "flag_duplicate_timestamp",
    "flag_time_gap_gt_expected", "flag_row_length_mismatch", "flag_non_numeric_in_numeric_field",
)
PUMP_STATE_FIELD = "triplex_on_off"
INDEX_FIELD = "raw_row_index"

# Definitions of the known channels.
DEFINITIONS = {
    "Time": "Date/time of the observation.",
    "Net Flow": "Injection water flow rate from Triplex pump.",
    "Injection EC": "Electrical conductivity associated with injected water.",
    "Injection Pressure": "Injection pressure associated with the active injection interval.",
    "PT 403": "Pressure transducer reading from sensor PT 403.",
    "PT 503": "Pressure transducer reading from sensor PT 503.",
    "PT 504": "Pressure transducer reading from sensor PT 504.",
}
# The five wells, and the channels each of them has.
WELLS = ("TL", "TN", "TC", "TU", "TS")
WELL_DEFINITIONS = {
    "{w} Interval Flow": "Production water flow rate {w} interval.",
    "{w} Bottom Flow": "Production water flow rate {w} bottom.",
    "{w} Collar Flow": "Production water flow rate {w} collar.",
    "{w} Interval EC": "Water EC {w} interval.",
    "{w} Bottom EC": "Water EC {w} bottom.",
    "{w} Interval Pressure": "Water pressure {w} interval.",
    "{w} Bottom Pressure": "Water pressure {w} bottom.",
    "{w} Packer Pressure": "Packer pressure {w}.",
    "{w} Packer Center Depth": "Center depth of {w} packer.",
}
# Thermocouples, which the well TS does not have.
THERMOCOUPLE_DEFINITIONS = {
    "{w}-TEC-INT-U": "Temperature {w} interval upper.",
    "{w}-TEC-INT-L": "Temperature {w} interval lower.",
    "{w}-TEC-BOT-U": "Temperature {w} bottom upper.",
    "{w}-TEC-BOT-L": "Temperature {w} bottom lower.",
}
for _well in WELLS:
    for _term, _text in WELL_DEFINITIONS.items():
        DEFINITIONS[_term.format(w=_well)] = _text.format(w=_well)
    if _well != "TS":
        for _term, _text in THERMOCOUPLE_DEFINITIONS.items():
            DEFINITIONS[_term.format(w=_well)] = _text.format(w=_well)

# Rules over the lower-case name, first match wins: (pattern, definition start, unit).
_TRANSDUCER = r"^pt\s*\d+"
_CONDUCTIVITY = r"(^|[^a-z0-9])ec([^a-z0-9]|$)"
_RULES = (
    ("flow", "Flow measurement for", "L/min"),
    (f"pressure|{_TRANSDUCER}", "Pressure measurement for", "psi"),
    ("tec", "Thermocouple temperature measurement for", "C"),
    ("depth", "Depth measurement for", "Feet"),
    (_CONDUCTIVITY, "Electrical conductivity measurement for", "EC units not explicitly stated"),
)


def named(column: str) -> Column:
    """The column of exactly this name, also with dots in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str], role: str) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing {role} column(s): {', '.join(missing)}")


# One file's header -----------------------------------------------------------------------


@dataclass(frozen=True)
class HeaderField:
    source: str
    clean: str
    role: str  # time, index, boolean, state or numeric


def normalize_header(header: str, fallback: str) -> str:
    words = re.findall("[a-z0-9]+", header.strip().replace(BOOLEAN_MARK, "").lower())
    return "_".join(words) or fallback


def unique_names(names: Sequence[str]) -> list[str]:
    """Number repeats ``_2``, ``_3`` in order; again on the result while repeats remain."""
    result = list(names)
    while len(set(result)) < len(result):
        seen: dict[str, int] = {}
        numbered = []
        for name in result:
            seen[name] = seen.get(name, 0) + 1
            numbered.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
        result = numbered
    return result


def header_mapping(headers: Sequence[str], config: SeriesConfig) -> list[HeaderField]:
    """Source name, unique clean name and role of each header, in file order."""
    headers = [headers[0].removeprefix(BYTE_ORDER_MARK), *headers[1:]] if headers else []
    if headers.count("Time") != 1:
        raise ValueError("the header needs exactly one column named 'Time'")
    cleaned = []
    for position, source in enumerate(headers):
        blank_first = position == 0 and not source.strip()
        clean = normalize_header(source, INDEX_FIELD if blank_first else f"column_{position + 1}")
        cleaned.append(f"{clean}_2" if clean in RESERVED else clean)
    fields = []
    for source, clean in zip(headers, unique_names(cleaned), strict=True):
        if source == "Time":
            role = "time"
        elif clean == INDEX_FIELD:
            role = "index"
        elif BOOLEAN_MARK in source:
            role = "boolean"
        elif config.has_pump_state and clean == PUMP_STATE_FIELD:
            role = "state"
        else:
            role = "numeric"
        fields.append(HeaderField(source, clean, role))
    return fields


# Replacements that make a name fit for models.
_ML_REPLACEMENTS = ((" ", "_"), ("-", "_"), ("/", "_per_"), ("(", ""), (")", ""))


def ml_name(name: str) -> str:
    for old, new in _ML_REPLACEMENTS:
        name = name.replace(old, new)
    return name.lower()


def ml_names(names: Sequence[str]) -> list[str]:
    return unique_names([ml_name(name) for name in names])


def infer_definition(name: str) -> str:
    if name in DEFINITIONS:
        return DEFINITIONS[name]
    low = name.lower()
    for pattern, start, _ in _RULES:
        if re.search(pattern, low):
            return f"{start} {name}."
    return DEFINITIONS["Time"] if low == "time" else f"Field representing {name}."


def infer_unit(name: str) -> str:
    low = name.lower()
    if low == "time":
        return "datetime"
    return next((unit for pattern, _, unit in _RULES if re.search(pattern, low)), "")


def field_metadata(field: HeaderField) -> dict[str, str]:
    """What a column's schema entry says of it; parquet keeps it with the column."""
    return {"source": field.source, "role": field.role, "unit": infer_unit(field.source.strip()),
            "definition": infer_definition(field.source.strip())}


def schema_values(df: DataFrame, column: Column, key: str) -> Column:
    """What the schema's metadata says under ``key`` of the column that ``column`` names; NULL
    where it says nothing."""
    known = [(f.name, f.metadata[key]) for f in df.schema.fields if f.metadata.get(key)]
    if not known:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for pair in known for x in pair]), column)


# A catalog of headers as a table ---------------------------------------------------------


def normalized_header(c: Column, fallback: Column) -> Column:
    text = F.lower(F.replace(strip(c), F.lit(BOOLEAN_MARK), F.lit("")))
    joined = F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(joined == "", fallback).otherwise(joined)


def header_fallback(c: Column, position: Column) -> Column:
    """Name of a header without letters or digits; ``position`` counts from 0."""
    blank_first = (position == 0) & (strip(c) == "")
    return F.when(blank_first, F.lit(INDEX_FIELD)).otherwise(
        F.concat(F.lit("column_"), (position + 1).cast("string"))
    )


def header_role(source: Column, clean: Column, has_pump_state: bool = False) -> Column:
    """Column form of the roles in :func:`header_mapping`."""
    role = F.when(source == "Time", F.lit("time")).when(clean == INDEX_FIELD, F.lit("index"))
    role = role.when(source.contains(BOOLEAN_MARK), F.lit("boolean"))
    if has_pump_state:
        role = role.when(clean == PUMP_STATE_FIELD, F.lit("state"))
    return role.otherwise(F.lit("numeric"))


def number_repeats(df: DataFrame, file_col: str, position: str, name: str) -> DataFrame:
    """Column form of :func:`unique_names`: rounds go on until a file's names are unique.

    The windows are as wide as one file's header; each round looks once whether repeats remain.
    """
    while True:
        order = W.partitionBy(file_col, name).orderBy(position)
        repeat = F.row_number().over(order)
        suffix = F.concat(F.col(name), F.lit("_"), repeat.cast("string"))
        df = df.withColumn(name, F.when(repeat == 1, F.col(name)).otherwise(suffix))
        if not df.groupBy(file_col, name).count().filter("count > 1").limit(1).count():
            return df


def ml_name_column(c: Column) -> Column:
    for old, new in _ML_REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.lower(c)


def definition_column(df: DataFrame, term: str, name: str = "definition") -> DataFrame:
    """Add the definition of each term: the known table first, then the name rules.

    The known table is the constant above, so the broadcast side never grows.
    """
    known = df.sparkSession.createDataFrame(list(DEFINITIONS.items()), "__term string, __known string")
    low = F.lower(F.col(term))
    guess = F.when(low == "time", F.lit(DEFINITIONS["Time"])).otherwise(
        F.concat(F.lit("Field representing "), F.col(term), F.lit("."))
    )
    for pattern, start, _ in reversed(_RULES):
        guess = F.when(low.rlike(pattern), F.concat(F.lit(start + " "), F.col(term), F.lit("."))).otherwise(guess)
    joined = df.join(F.broadcast(known), F.col(term) == F.col("__term"), "left")
    return joined.withColumn(name, F.coalesce("__known", guess)).drop("__term", "__known")


def unit_column(c: Column) -> Column:
    low = F.lower(c)
    unit = F.lit("")
    for pattern, _, text in reversed(_RULES):
        unit = F.when(low.rlike(pattern), F.lit(text)).otherwise(unit)
    return F.when(low == "time", F.lit("datetime")).otherwise(unit)
