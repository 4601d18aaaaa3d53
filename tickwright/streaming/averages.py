"""Window averages on a stream, late rows dropped by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tickwright.functions.times import epoch_micros, from_epoch_micros
from tickwright.operators.resample import window_average
from tickwright.operators.sequence import SERIES


def stream_window_average(stream: DataFrame, columns: Sequence[str], late: str = "10 minutes",
                          ts: str = "ts", width: str = "1 hour", series: Sequence[str] = SERIES) -> DataFrame:
    """A window is emitted once, when the watermark has passed its end.

    Watermarks need instants, so zone-less times are read as UTC and turned back at the end.
    """
    instants = stream.withColumn(ts, F.timestamp_micros(epoch_micros(F.col(ts))))
    averages = window_average(instants.withWatermark(ts, late), columns, ts, width, series)
    return averages.withColumn("window_start", from_epoch_micros(F.unix_micros("window_start")))


def start_to_parquet(averages: DataFrame, folder: str, **trigger) -> StreamingQuery:
    return (
        averages.writeStream.outputMode("append").format("parquet")
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed their window, as the query's progress
    counts them: rows of one window in one task are put together before they are dropped, so it
    is 0 only if none was late and else a lower bound.  Spark keeps the progress of the last
    ``spark.sql.streaming.numRecentProgressUpdates`` batches."""
    return sum(operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators)
