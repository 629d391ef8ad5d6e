"""Streaming forms of ingestion: read, clean, deduplicate, resume, store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from glossweave.functions.rules import passes_gate
from glossweave.operators.dedup import keep_last
from glossweave.plans.cleaning import clean_entries, split_rejects
from glossweave.plans.ingest import rate
from glossweave.session import scratch_path
from glossweave.sources.sinks import append_new

PROGRESS_COUNTS = "total long, processed long, succeeded long, failed long, skipped long"


def json_stream(
    spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100, skip_errors: bool = True
) -> DataFrame:
    """JSON-lines files of a folder (gzip by suffix) as a stream of micro-batches."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "DROPMALFORMED" if skip_errors else "FAILFAST").json(folder)
    )


def table_stream(spark: SparkSession, glob: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as a stream, with the schema of the files that are there."""
    schema = spark.read.parquet(glob).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)


def clean_stream(
    records: DataFrame, require_ipa: bool = False, min_definition: int = 10, tasks: int | None = None
) -> DataFrame:
    """Cleaning, gate and rating; stateless, so it works on batches and streams alike.

    ``tasks`` spreads each micro-batch first, for streams of few large files.
    """
    records = records.repartition(tasks) if tasks else records
    good, _ = split_rejects(clean_entries(records))
    return rate(good.filter(passes_gate(min_definition, require_ipa)))


def first_per_key(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Keeps one row per key. With an event time the state is bounded by ``delay``."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all data that is available now to parquet files, exactly once."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hands each micro-batch of the data available now to ``handle``."""
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def store_new(path: str, keys: list[str], order: list[str], progress_path: str | None = None):
    """Batch handler that adds rows with unknown keys to a table.

    The batch number is part of the stored rows' folder, so a batch that runs
    again after a failure overwrites its own rows and nothing else.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _earlier(spark, path, number, batch.select(*keys))
        fresh = append_new(before, batch, keys, order)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if progress_path:
            stored = spark.read.schema(batch.schema).parquet(f"{path}/batch={number}").count()
            total = batch.count()
            row = spark.createDataFrame([(total, total, stored, 0, total - stored)], PROGRESS_COUNTS)
            row.withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").parquet(f"{progress_path}/batch={number}")

    return handle


def store_changes(path: str):
    """Batch handler for upserts: appends the batch; :func:`current` merges on reading.

    Nothing that is stored gets rewritten, however large the table is, and a
    batch that runs again overwrites only itself.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row per key of a table written by :func:`store_changes`.

    Within one batch keys must be unique.
    """
    return keep_last(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def _earlier(spark: SparkSession, path: str, number: int, like: DataFrame) -> DataFrame:
    """Keys stored by earlier batches; none before the first."""
    if number == 0:
        return like.limit(0)
    return spark.read.parquet(path).filter(F.col("batch") < number).select(*like.columns)


def stream_through(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    run_to_table(stream, path, scratch_path(spark, f"{label}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


class Progress(StreamingQueryListener):
    """Running totals of a streaming query: rows, rate and rows still to come."""

    def __init__(self, total: int | None = None):
        self.total, self.rows, self.rows_per_second = total, 0, 0.0

    @property
    def remaining(self) -> int | None:
        return None if self.total is None else max(self.total - self.rows, 0)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.rows_per_second = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
