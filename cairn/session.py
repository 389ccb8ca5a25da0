"""Session helpers: a local session for tests, and lineage cuts for iterative jobs."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. Cluster jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairn")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# What one task reads of a shuffle, and into how many parts a shuffle is cut before they are put together again.
TASK_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
}


def bound_tasks(spark: SparkSession) -> None:
    """Let tasks read about 16 MB of a shuffle each, unless the session says otherwise.

    A task that joins, ranks and groups holds 20 to 40 times what it reads. At
    Spark's 64 MB and 200 parts that grows with the tables to several GB.
    """
    for name, value in TASK_SIZES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder().name


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """One temporary folder per process, removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="cairn-", ignore_cleanup_errors=True)


class Stages:
    """Written tables that stand between the rounds of one iterative job.

    Writing a table runs the plan once, survives the loss of executors, and
    gives the next round true sizes for its join choices. Tables are packed
    more than by default, as they stay until the job ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/stages-{uuid.uuid4().hex}"
        self.count = 0
        self.seen: dict[str, int] = {}

    def cut(self, df: DataFrame, *flags: str) -> DataFrame:
        """Write the table and read it back.

        ``flags`` are conditions; ``self.seen`` tells how many rows met each,
        counted while the table was written.
        """
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        watched, note = df, None
        if flags:
            note = Observation()
            watched = df.observe(
                note, *[F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(c) for c in flags]
            )
        watched.write.parquet(path, compression="zstd")
        self.seen = note.get if note else {}
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)
