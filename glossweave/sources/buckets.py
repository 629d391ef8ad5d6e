"""Keyed tables in hash buckets: an upsert rewrites only the buckets that hold a changed key.

A table is a folder of Parquet partitions bucket=…/batch=…; the newest batch of
a bucket is that bucket. A write of batch N reads what batches before N left in
the buckets its keys fall into, merges, and replaces its own partitions by
dynamic partition overwrite. So nothing that readers use is overwritten, a
batch that runs again after a failure gives the same table, and buckets without
a changed key keep their files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossweave.operators.dedup import keep_last
from glossweave.session import materialize
from glossweave.sources.sinks import upsert

PLACE = ("bucket", "batch")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Newest batch of each bucket, of those before a batch number; empty where there is no table yet."""
    try:
        found = spark.read.parquet(path).groupBy("bucket").agg(
            F.max("batch" if before is None else F.when(F.col("batch") < before, F.col("batch"))).alias("batch")
        )
        # At most one row per bucket.
        return {r.bucket: r.batch for r in found.collect() if r.batch is not None}
    except AnalysisException:
        return {}


def current(spark: SparkSession, path: str, columns: str, at: dict[int, int] | None = None) -> DataFrame:
    """The rows of a table, read from the newest partition of each bucket (or of ``at``); ``columns`` is its schema."""
    at = versions(spark, path) if at is None else at
    if not at:
        return spark.createDataFrame([], columns)
    names = spark.createDataFrame([], columns).columns
    rows = spark.read.schema(f"{columns}, bucket int, batch long").parquet(path)
    # Only partition columns, so other partitions are not even listed for reading.
    place = F.concat_ws("/", "bucket", "batch")
    return rows.filter(place.isin([f"{b}/{n}" for b, n in sorted(at.items())])).select(*names)


def upsert_batch(
    spark: SparkSession,
    path: str,
    columns: str,
    changes: DataFrame,
    keys: list[str],
    update: list[str],
    buckets: int,
    batch: int | None = None,
    order: list[str] | None = None,
    touch: dict[str, Column] | None = None,
    settled: bool = False,
) -> set[int]:
    """Merges changes into the table and returns the buckets that were written.

    Unknown keys are inserted, the ``update`` columns of known ones overwritten
    and ``touch`` set for these; with ``order`` the last change per key wins.
    The bucket number depends on the keys alone, so ``buckets`` must stay the
    same for a table. ``settled`` says that ``changes`` are read from files.
    """
    if batch is None:
        batch = max(versions(spark, path).values(), default=-1) + 1
    if not settled:
        changes = materialize(changes, "changes")
    touched = {r.bucket for r in changes.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect()}
    if not touched:
        return touched
    earlier = {b: n for b, n in versions(spark, path, before=batch).items() if b in touched}
    stored = current(spark, path, columns, earlier)
    if order:
        changes = materialize(keep_last(changes, keys, order), "changes")
    # The keys that are on both sides are found first; rows with other keys then pass without a join of their own where these are few.
    known = materialize(changes.select(*keys).join(stored.select(*keys), keys, "left_semi"), "known")
    met = upsert(stored.join(known, keys, "left_semi"), changes.join(known, keys, "left_semi"), keys, update, touch=touch)
    added = changes.join(known, keys, "left_anti").select(*[c for c in stored.columns if c in changes.columns])
    merged = stored.join(known, keys, "left_anti").unionByName(met).unionByName(added, allowMissingColumns=True)
    placed = merged.withColumns({"bucket": bucket_of(keys, buckets), "batch": F.lit(batch).cast("long")})
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)
    return touched
