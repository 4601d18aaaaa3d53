"""Loading typed tables by file suffix, and stacking configured series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwright.functions.cells import as_number, strip
from tickwright.functions.names import named
from tickwright.operators.wide import per_column
from tickwright.sources.delimited import ORDINAL, read_named

# Cell texts that a typed load takes as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
# Cell texts that a typed load takes as booleans.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a table by its suffix: .csv (typed by its values), .parquet or .json.

    Cells can hold line breaks.  Cells of a text file are staged once and their types found
    there; give ``schema`` to skip that, at the price of one task per file.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    try:
        if suffix == ".csv":
            if schema is not None:
                return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)
            return infer_types(read_named(spark, path, trim=False).drop(ORDINAL))
        if suffix == ".parquet":
            return (spark.read.schema(schema) if schema else spark.read).parquet(path)
        if suffix == ".json":
            return (spark.read.schema(schema) if schema else spark.read).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"input file not found: {path}") from error
        raise
    raise ValueError(f"unsupported file type: {suffix or path}")


def infer_types(df: DataFrame) -> DataFrame:
    """Type text columns by their values: integer, float, boolean or text.

    Integers and booleans need every row filled; numbers with missing cells become floats.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    cells = {c: F.when(~named(c).isin(*MISSING_TEXTS), named(c)) for c in names}

    def is_integer(c):
        return c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("bigint").isNotNull()

    found = per_column(df, [
        F.struct(
            F.lit(name).alias("column"), F.count("*").alias("rows"), F.count(c).alias("filled"),
            F.count_if(is_integer(c)).alias("integers"),
            F.count_if(as_number(strip(c)).isNotNull()).alias("numbers"),
            F.count_if(c.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias("booleans"))
        for name, c in cells.items()
    ]).collect()
    typed = {}
    for name, rows, filled, integers, numbers, booleans in found:
        c, complete = cells[name], filled == rows and filled > 0
        if complete and booleans == filled:
            typed[name] = c.isin(*TRUE_TEXTS)
        elif complete and integers == filled:
            typed[name] = c.try_cast("bigint")
        elif numbers == filled:
            typed[name] = as_number(strip(c))
        else:
            typed[name] = c
    return df.withColumns(typed)


def stack_series(frames: dict[str, DataFrame]) -> DataFrame:
    """All series under one schema, tagged with ``source_dataset``; absent columns are NULL."""
    tagged = [df.withColumn("source_dataset", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reduced projection; only these columns are read from a columnar source."""
    return df.select(*columns)
