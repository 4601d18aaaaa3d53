"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tickwright") -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, which a cluster points at shared
    storage.  Only where it is unset (tests, a laptop) a temporary folder is set instead."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tickwright-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class Staged:
    """Owner of the tables staged inside a ``with`` block: they are deleted when it ends.

    Blocks nest, and each thread has its own, so flows can run beside each other.
    """

    _open: ContextVar[tuple[Staged, ...]] = ContextVar("staged", default=())

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Staged:
        Staged._open.set((*Staged._open.get(), self))
        return self

    def take_last(self) -> str:
        """The path staged last, which the caller then owns."""
        return self.paths.pop()

    def __exit__(self, *_) -> None:
        Staged._open.set(tuple(block for block in Staged._open.get() if block is not self))
        for path in self.paths:
            delete_path(self.spark, path)


def stage_table(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage with storage that outlives executors, and later readers prune columns,
    which a cached or checkpointed frame would not.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    if blocks := Staged._open.get():
        blocks[-1].paths.append(path)
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", 0)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
