"""From raw records to typed entries: clean, gate, deduplicate, rate, embed, assign."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from glossweave.functions import ids, rules
from glossweave.operators.concepts import assign, embed_missing, hashed_vectors
from glossweave.operators.dedup import keep_first
from glossweave.plans.cleaning import PIPELINE_VERSION, clean_entries, split_rejects
from glossweave.session import materialize_counting, settle
from glossweave.sources.readers import as_raw, reader
from glossweave.sources.sinks import append_new, append_table


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """Counts rows (and rows per condition) as they pass, without another job."""
    watch = Observation(name)
    extra = [F.count_if(cond).alias(key) for key, cond in conditions.items()]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *extra), watch


def rate(entries: DataFrame, rule_set: str = "standard") -> DataFrame:
    """Adds validation_errors (null when there are none) and data_quality."""
    found = rules.errors(rules.RULE_SETS[rule_set]())
    out = entries.withColumn("_errors", found)
    some = F.size("_errors") > 0
    out = out.withColumn("validation_errors", F.when(some, F.col("_errors"))).drop("_errors")
    vector = F.col("embedding") if "embedding" in entries.columns else F.lit(None)
    quality = rules.entry_quality(
        F.col("etymology"), F.col("pos_tag"), vector,
        F.when(F.col("validation_errors").isNotNull(), F.size("validation_errors")), F.col("definition"),
    )
    return out.withColumn("data_quality", quality)


def quality_metrics(entries: DataFrame, rule_set: str = "standard") -> DataFrame:
    """Long table of metrics per entry: (entry_id, metric_name, metric_value)."""
    n = F.size(rules.errors(rules.RULE_SETS[rule_set]()))
    wide = entries.select(
        F.col("id").alias("entry_id"), rules.rule_score(n).alias("rule_score"), n.cast("double").alias("rule_errors"),
        F.length("definition").cast("double").alias("definition_length"),
    )
    return wide.unpivot("entry_id", None, "metric_name", "metric_value")


def typed_entries(
    records: DataFrame,
    order: list[str],
    require_ipa: bool = False,
    min_definition: int = 10,
    keys: tuple[str, ...] = ("headword", "language"),
) -> DataFrame:
    """Cleaned, gated and globally unique entries with content ids."""
    good, _ = split_rejects(clean_entries(records))
    gated = good.filter(rules.passes_gate(min_definition, require_ipa))
    unique = keep_first(gated, list(keys), order)
    entry_id = ids.content_id(F.col("headword"), F.col("language"), F.col("definition"))
    return unique.withColumn("id", entry_id).withColumn("pipeline_version", F.lit(PIPELINE_VERSION))


def full_run(
    records: DataFrame,
    order: list[str],
    concepts: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame] = hashed_vectors,
    rule_set: str = "standard",
) -> DataFrame:
    """The whole chain in one plan; vectors are computed once and used twice."""
    entries = typed_entries(records, order)
    if "embedding" not in entries.columns:
        entries = entries.withColumn("embedding", F.lit(None).cast("array<float>"))
    placed = assign(embed_missing(entries, embed), concepts)
    return rate(placed.withColumnRenamed("confidence", "concept_confidence"), rule_set)


def reprocess(
    raw: DataFrame, read: Callable[[DataFrame], DataFrame], order: list[str], version: str, source_id: str | None = None
) -> DataFrame:
    """Runs the chain again over stored raw rows, of one source or of all."""
    chosen = raw if source_id is None else raw.filter(F.col("source_id") == source_id)
    return typed_entries(read(chosen), order).withColumn("pipeline_version", F.lit(version))


ENTRY_FIELDS = "headword string, ipa string, language string, definition string, etymology string, pos_tag string"


def from_raw(raw: DataFrame) -> DataFrame:
    """Entry records out of stored raw rows; each row is parsed once."""
    parsed = raw.select("source_id", "checksum", F.from_json("raw_data", ENTRY_FIELDS).alias("_r"))
    return settle(parsed.select("source_id", "checksum", "_r.*"))


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or an empty one of the same columns before the first write."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], like.schema)


def ingest_file(
    spark: SparkSession, format: str, path: str, source_id: str, store: str, require_ipa: bool = False
) -> dict[str, int]:
    """Loads dictionary files into ``store``/raw and ``store``/entries; returns counters.

    Raw rows are added once per checksum. New raw rows become entries unless
    they fail the gate or their (headword, language) is there already. Loading
    the same files again adds nothing.
    """
    raw = as_raw(reader(format)(spark, path), source_id)
    raw, loaded = materialize_counting(raw, "true", "raw")
    known = stored(spark, f"{store}/raw", raw)
    new_raw, added = materialize_counting(append_new(known, raw, ["checksum"], ["checksum"]), "true", "new-raw")
    append_table(new_raw, f"{store}/raw")

    entries = rate(typed_entries(from_raw(new_raw), ["checksum"], require_ipa))
    before = stored(spark, f"{store}/entries", entries)
    fresh, saved = materialize_counting(
        entries.join(before.select("headword", "language"), ["headword", "language"], "left_anti").select(*entries.columns),
        "true", "entries",
    )
    append_table(fresh, f"{store}/entries")
    return {
        "loaded": loaded, "raw_added": added, "raw_duplicates": loaded - added,
        "saved": saved, "rejected_or_duplicate": added - saved,
    }
