"""Table writes: append once, upsert, delete.

Operators return the table that results from the write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.operators.dedup import keep_first, keep_last


def append_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows to add: first per key, and only keys the target lacks."""
    return keep_first(rows, keys, order).join(target.select(*keys), keys, "left_anti")


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: list[str],
    update: list[str],
    order: list[str] | None = None,
    touch: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert unknown keys, overwrite the ``update`` columns of known ones.

    With ``order`` the last change per key wins; without it keys must be
    unique. ``touch`` sets further columns of overwritten rows. The target is
    read by a left join, so a small batch of changes is broadcast by its size
    and a large one shuffled; no full outer join is needed.
    """
    last = keep_last(changes, keys, order) if order else changes
    fresh = last.select(*keys, F.struct(*update).alias("_new"))
    met = target.join(fresh, keys, "left")
    hit = F.col("_new").isNotNull()
    sets = {c: F.col(f"_new.{c}") for c in update} | (touch or {})
    kept = met.select(
        *[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns]
    )
    added = last.join(target.select(*keys), keys, "left_anti")
    return kept.unionByName(added.select(*[c for c in target.columns if c in added.columns]), allowMissingColumns=True)


# Columns each kind of write may overwrite.
SOURCE_UPDATES = ["name", "version", "retrieved_at"]
ENTRY_UPDATES = ["headword", "ipa", "definition", "etymology", "pos_tag", "embedding"]
BULK_UPDATES = [*ENTRY_UPDATES, "concept_id", "data_quality"]
ASSIGNMENT_UPDATES = ["embedding", "concept_id"]
CONCEPT_UPDATES = ["centroid", "size", "confidence"]
SET_UPDATES = ["size", "confidence", "semantic_core"]


def delete_ids(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti")


def delete_source(target: DataFrame, source_id: str) -> DataFrame:
    return target.filter(~F.coalesce(F.col("source_id") == source_id, F.lit(False)))


def missing_languages(raw: DataFrame, languages: DataFrame) -> DataFrame:
    """One new language row per code that raw records use and no row has."""
    used = raw.filter("lang_code is not null and lang_code <> ''")
    named = used.groupBy(F.col("lang_code").alias("iso_code")).agg(F.min("lang").alias("name"))
    new = named.join(languages.select("iso_code"), "iso_code", "left_anti")
    return new.select("iso_code", "name", F.lit("Unknown").alias("branch"), F.lit(None).cast("string").alias("subfamily"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_entries(df: DataFrame, path: str) -> None:
    """Typed entries laid out by language, the filter most queries use."""
    df.write.mode("append").partitionBy("language").parquet(path)


def progress_row(batch: DataFrame, total: Column | int | None = None) -> DataFrame:
    """One progress row; ``batch`` has a boolean column per outcome."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    processed = F.count(F.lit(1))
    return batch.agg(
        F.current_timestamp().alias("timestamp"),
        (F.lit(total).cast("long") if total is not None else processed).alias("total"),
        processed.alias("processed"),
        count("succeeded").alias("succeeded"), count("failed").alias("failed"), count("skipped").alias("skipped"),
    )
