"""The whole chain on a stream: clean, gate, embed, assign, rate, upsert.

Every micro-batch is one set of Spark jobs. Its rows are written once after
cleaning and once as finished entries; the upsert then rewrites the buckets
that hold one of their ids (see :mod:`glossweave.sources.buckets`). All writes
carry the batch number, so a run that is stopped anywhere and started again
gives the table of an undisturbed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.functions import ids
from glossweave.functions.rules import passes_gate
from glossweave.operators.concepts import assigner, embed_missing, hashed_vectors
from glossweave.operators.dedup import keep_last
from glossweave.plans.cleaning import PIPELINE_VERSION, clean_entries
from glossweave.plans.ingest import rate
from glossweave.session import materialize
from glossweave.sources import buckets as tables
from glossweave.streaming.jobs import run_batches

ENTRY = (
    "id string, headword string, ipa string, language string, definition string, etymology string, pos_tag string, source_id string, "
    "embedding array<float>, concept_id string, concept_confidence double, data_quality double, pipeline_version string, "
    "created_batch long, updated_batch long"
)
UPDATES = [
    "headword", "ipa", "definition", "etymology", "pos_tag", "embedding", "concept_id", "concept_confidence", "data_quality", "pipeline_version",
]


class Chain:
    """Batch handler; the centroids are read once, when it is made."""

    def __init__(
        self,
        path: str,
        concepts: DataFrame,
        embed: Callable[[DataFrame, str], DataFrame] = hashed_vectors,
        order: tuple[str, ...] = ("source_id",),
        buckets: int = 64,
        require_ipa: bool = False,
        min_definition: int = 10,
        rule_set: str = "standard",
        progress: str | None = None,
        skip_existing: bool = False,
    ):
        self.path, self.embed, self.order, self.buckets, self.progress = path, embed, list(order), buckets, progress
        self.gate, self.rule_set, self.skip_existing = passes_gate(min_definition, require_ipa), rule_set, skip_existing
        self.assign = assigner(concepts)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        outcome = F.when(F.size("rejects") > 0, "failed").when(self.gate, "good").otherwise("skipped")
        judged = materialize(clean_entries(batch).withColumn("_outcome", outcome), "cleaned")
        good = judged.filter("_outcome = 'good'").drop("_outcome", "rejects")
        good = good.withColumn("id", ids.content_id(F.col("headword"), F.col("language"), F.col("definition")))
        # Only entries whose id is there again are shuffled as a whole.
        again = materialize(good.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "again")
        several = good.join(again, "id", "left_semi").unionByName(good.filter("id IS NULL"))
        entries = good.filter("id IS NOT NULL").join(again, "id", "left_anti").unionByName(keep_last(several, ["id"], self.order))
        if self.skip_existing:
            # Ids are made of the content, so an entry that is stored has its vector.
            known = tables.current(spark, self.path, ENTRY, tables.versions(spark, self.path, before=number))
            entries = entries.join(known.filter("embedding IS NOT NULL").select("id"), "id", "left_anti")
        if "embedding" not in entries.columns:
            entries = entries.withColumn("embedding", F.lit(None).cast("array<float>"))
        placed = self.assign(embed_missing(entries, self.embed)).withColumnRenamed("confidence", "concept_confidence")
        rated = rate(placed, self.rule_set).withColumns({
            "pipeline_version": F.lit(PIPELINE_VERSION), "created_batch": F.lit(number).cast("long"), "updated_batch": F.lit(number).cast("long"),
        })
        names = spark.createDataFrame([], ENTRY).columns
        done = materialize(rated.select(*[F.col(c) if c in rated.columns else F.lit(None).alias(c) for c in names]), "entries")
        tables.upsert_batch(
            spark, self.path, ENTRY, done, ["id"], UPDATES, self.buckets, number,
            touch={"updated_batch": F.lit(number).cast("long")}, settled=True,
        )
        if self.progress:
            self.report(judged, done, number)

    def report(self, judged: DataFrame, done: DataFrame, number: int) -> None:
        """One row of counts per batch, under its number: a repeated batch replaces its row."""
        counts = judged.agg(
            F.current_timestamp().alias("timestamp"), F.count(F.lit(1)).alias("processed"),
            F.count_if(F.col("_outcome") == "failed").alias("failed"), F.count_if(F.col("_outcome") == "skipped").alias("skipped"),
        )
        written = done.agg(F.count(F.lit(1)).alias("written"), F.count("embedding").alias("embedded"))
        row = {**counts.first().asDict(), **written.first().asDict()}
        schema = "timestamp timestamp, processed long, failed long, skipped long, written long, embedded long"
        spark = judged.sparkSession
        spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema).write.mode("overwrite").parquet(
            f"{self.progress}/batch={number}"
        )


def run_chain(stream: DataFrame, chain: Chain, checkpoint: str) -> None:
    """Runs all data that is available now through the chain, micro-batch by micro-batch."""
    run_batches(stream, chain, checkpoint).awaitTermination()


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    return tables.current(spark, path, ENTRY)


def progress_totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts over all batches, one row."""
    rows = spark.read.parquet(path)
    return rows.agg(*[F.sum(c).alias(c) for c in ("processed", "failed", "skipped", "written", "embedded")], F.count_distinct("batch").alias("batches"))
