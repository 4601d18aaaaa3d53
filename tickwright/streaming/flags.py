"""QA flags on a stream of sensor rows.

Each micro-batch is flagged with the same chunked look-back as a batch table, starting from
the state that the batch before left: of each series the last valid time, the last ordinal and
the last row that is no repeat.  A state kept per key inside the stream would put a busy series
into one task; here its rows spread over chunks.  Rows are in ordinal order inside a batch, and
batches must follow each other in ordinal order; one that does not is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tickwright.operators.ordered import look_back
from tickwright.operators.sequence import SERIES, duplicate_run_groups, time_flags
from tickwright.session import Staged, delete_path, stage_table

REPEAT = "flag_duplicate_timestamp"
# One level of chunks: a micro-batch of a hundred million rows has some 24,000 of them.
LEVELS = 1


class StreamFlagger:
    """Writes flagged rows and state, both in one folder per micro-batch.

    A micro-batch that is run again overwrites its own folders and reads the state of the
    batch before it, so the outcome is the same as for a single run.
    """

    def __init__(self, folder: str, cadence: Column | int, ts: str = "ts", ordinal: str = "ordinal",
                 series: Sequence[str] = SERIES, prepare: Callable[[DataFrame], DataFrame] | None = None):
        self.folder, self.cadence, self.ts, self.ordinal = folder.rstrip("/"), cadence, ts, ordinal
        self.series, self.prepare = list(series), prepare

    def _part(self, kind: str, epoch: int) -> str:
        return f"{self.folder}/{kind}/epoch={epoch}"

    def process(self, batch: DataFrame, epoch: int) -> None:
        """Flag one micro-batch, which is evaluated once, and hand its state on.

        Three writes: the rows, with the check of their order on the way; how many repeats each
        run has in this batch; the state.  A run that goes on from an earlier batch has the same
        start there, so counts of its parts add up and nothing is closed or kept open.
        """
        spark, keys = batch.sparkSession, self.series
        rows = stage_table(self.prepare(batch) if self.prepare else batch, "micro-batch")
        state_type = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields]
        schema = ", ".join([*state_type, "prev_valid_time timestamp_ntz", "last_ordinal long", "run_start long"])
        before = spark.read.schema(schema).parquet(self._part("state", epoch - 1)) if epoch > 0 else None

        carried = {"prev_valid_time": F.col(self.ts), "last_ordinal": F.lit(None).cast("long")}
        seen = look_back(rows, carried, keys, self.ordinal, levels=LEVELS, initial=before)
        flagged = time_flags(seen, self.cadence, self.ts)
        order = Observation()
        checked = flagged.observe(order, F.count_if(F.col(self.ordinal) <= F.col("last_ordinal")).alias("early"))
        kept = checked.drop("prev_valid_time", "last_ordinal")
        kept.write.mode("overwrite").parquet(self._part("rows", epoch))
        if order.get["early"]:
            raise ValueError(f"micro-batch {epoch} holds rows before the end of an earlier one; batches must come in order of {self.ordinal}")

        written = spark.read.schema(kept.schema).parquet(self._part("rows", epoch)).select(*keys, self.ordinal, self.ts, REPEAT)
        runs = duplicate_run_groups(written, keys, self.ordinal, levels=LEVELS, initial=before)
        runs.select(*keys, "run_start", (F.col("run_length") - 1).alias("repeats")).write.mode("overwrite").parquet(self._part("runs", epoch))

        at = F.col(self.ordinal).cast("long")
        now = written.select(*keys, F.col(self.ts).alias("prev_valid_time"), at.alias("last_ordinal"),
                             F.when(~F.col(REPEAT), at).alias("run_start"))
        known = now.unionByName(before) if before is not None else now
        timed = F.when(F.col("prev_valid_time").isNotNull(), F.col("last_ordinal"))
        known.groupBy(*keys).agg(
            F.max_by("prev_valid_time", timed).alias("prev_valid_time"), F.max("last_ordinal").alias("last_ordinal"),
            F.max("run_start").alias("run_start")).write.mode("overwrite").parquet(self._part("state", epoch))
        if epoch > 1:  # a batch that runs again needs the state before it, none before that
            delete_path(spark, self._part("state", epoch - 2))

    def run_lengths(self, spark: SparkSession) -> DataFrame:
        """How many runs of repeats there are of each length, with those still open."""
        parts = spark.read.parquet(f"{self.folder}/runs")
        runs = parts.groupBy(*self.series, "run_start").agg((F.sum("repeats") + 1).alias("run_length"))
        return runs.groupBy(*self.series, "run_length").agg(F.count("*").alias("runs"))

    def _owned(self, batch: DataFrame, epoch: int) -> None:
        with Staged(batch.sparkSession):
            self.process(batch, epoch)

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self._owned)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    @property
    def rows_path(self) -> str:
        return f"{self.folder}/rows"
