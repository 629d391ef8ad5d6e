"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No call site is recorded for every column; wide plans build much faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "glossweave", **conf) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a step as a table in the shared folder and continue from the files.

    The result has no lineage behind it, survives lost executors, and carries
    exact file sizes, so the planner broadcasts it only when it really is small
    and can split its skewed partitions when it is not. What the step shuffled is
    deleted once it is written: nothing reads it again, and it would else stay on
    disk until the driver collects garbage, which may be many steps later.
    """
    path = scratch_path(df.sparkSession, label)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside only."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize_counting(df: DataFrame, condition: str, label: str = "step") -> tuple[DataFrame, int]:
    """:func:`materialize`, and how many rows met a condition, in the same job."""
    watch = Observation()
    out = materialize(df.observe(watch, F.count_if(F.expr(condition)).alias("n")), label)
    return out, watch.get["n"]


def fits_in_memory(df: DataFrame, bytes_per_row: int, budget: int = 64 << 20) -> bool:
    """True when the frame is small enough to hand to every task."""
    most = budget // max(bytes_per_row, 1)
    return df.limit(most + 1).count() <= most


def share(df: DataFrame) -> DataFrame:
    """Spreads a small input over all cores before costly work on each row.

    For frames read straight from files (others would run to count partitions).
    Fewer scan partitions than cores means less than one file split per core,
    so the shuffle is small; larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Whatever is written inside hands rows to Python in batches of about this many bytes.

    Spark's own bound of 64 MB is held on both sides of every task, in buffers
    twice that size while they grow. For rows that are whole texts.
    """
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


def settle(df: DataFrame) -> DataFrame:
    """Keeps later filters above the columns computed so far.

    A filter on a costly column would else be pushed to the scan with the whole
    computation inside, which would then run again for the output.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
