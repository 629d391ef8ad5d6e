"""Filters and joins over entries, concepts, sources and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.functions.tree import branch_codes
from glossweave.functions.vectors import cosine
from glossweave.operators.skew import MAX_TAXA, require_small_groups
from glossweave.operators.windows import first_n
from glossweave.session import materialize


def by_id(df: DataFrame, value) -> DataFrame:
    return df.filter(F.col("id") == value)


def query(df: DataFrame, **filters) -> DataFrame:
    """AND of equality filters; those given as None are left out."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def in_branch(df: DataFrame, branch: str) -> DataFrame:
    """Entries whose language belongs to a tree branch at any depth."""
    codes = branch_codes(branch)
    return df.filter(F.col("language").isin(codes)) if codes else df.limit(0)


def scan(df: DataFrame, source_id=None, resume_from=None) -> DataFrame:
    """Rows after a resume point in id order, of one source or of all."""
    out = query(df, source_id=source_id)
    if resume_from is not None:
        out = out.filter(F.col("id") > resume_from)
    return out.orderBy("id")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def missing_embedding(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNull())


def strong_edges(edges: DataFrame, threshold: float, weight: str = "weight") -> DataFrame:
    return edges.filter(F.col(weight) >= threshold)


def concept_by_label(concepts: DataFrame, text: str) -> DataFrame:
    """Best concept whose label contains the text, whatever the case."""
    hit = concepts.filter(F.col("label").ilike(f"%{text}%"))
    return hit.orderBy(F.desc("size"), "id").limit(1)


def concept_entries(
    entries: DataFrame, concept_id, language: str | None = None, limit: int | None = None
) -> DataFrame:
    out = query(entries, concept_id=concept_id, language=language)
    return out.orderBy("id").limit(limit) if limit else out


def search_vectors(
    entries: DataFrame, vector: Column | list[float], limit: int = 10, threshold: float = 0.7
) -> DataFrame:
    """Entries closest to a query vector, as a top-k that never sorts all rows."""
    target = vector if isinstance(vector, Column) else F.array(*map(F.lit, vector))
    scored = missing_removed(entries).withColumn("similarity", cosine(F.col("embedding"), target))
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)


def missing_removed(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("embedding").isNotNull())


def similar_entries(edges: DataFrame, entries: DataFrame, entry_id, limit: int = 10) -> DataFrame:
    """Entries linked to one entry by an edge in either direction, best first."""
    a, b = F.col("entry_a"), F.col("entry_b")
    mine = edges.filter((a == entry_id) | (b == entry_id)).withColumn(
        "entry_id", F.when(a == entry_id, b).otherwise(a)
    )
    named = mine.join(entries.select(F.col("id").alias("entry_id"), "headword", "language"), "entry_id")
    scores = [c for c in edges.columns if c.endswith("_score")]
    return (
        named.select("entry_id", "headword", "language", *scores)
        .orderBy(F.desc("combined_score"), "entry_id")
        .limit(limit)
    )


def lexical_differences(edges: DataFrame, entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Scored word pairs of one concept in two languages.

    Starts from the edge table, so the result grows with the scored pairs and
    not with the square of a concept. :func:`unscored_pairs` accounts for the
    pairs without a score.
    """
    side = lambda s: entries.select(
        F.col("id").alias(f"entry_{s}"), F.col("concept_id").alias(f"concept_{s}"),
        F.col("language").alias(f"language_{s}"), F.col("headword").alias(f"form_{s}"),
        F.col("ipa").alias(f"ipa_{s}"),
    )
    scores = [c for c in edges.columns if c.endswith("_score") or c == "phylogenetic_distance"]
    bare = edges.select("entry_a", "entry_b", *scores)
    met = bare.join(side("a"), "entry_a").join(side("b"), "entry_b")
    met = met.filter(
        (F.col("concept_a") == F.col("concept_b")) & (F.col("language_a") != F.col("language_b"))
    )
    flip = F.col("language_a") > F.col("language_b")
    pick = lambda name: [
        F.when(flip, F.col(f"{name}_b")).otherwise(F.col(f"{name}_a")).alias(f"{name}_a"),
        F.when(flip, F.col(f"{name}_a")).otherwise(F.col(f"{name}_b")).alias(f"{name}_b"),
    ]
    oriented = met.select(
        F.col("concept_a").alias("concept_id"), *pick("language"), *pick("form"), *pick("ipa"), *scores
    )
    labels = concepts.select(F.col("id").alias("concept_id"), F.col("label").alias("concept_label"))
    return oriented.join(labels, "concept_id")


def language_pair_sizes(entries: DataFrame, concept: str = "concept_id") -> DataFrame:
    """Number of cross-language word pairs per concept and language pair."""
    sizes = entries.filter(F.col(concept).isNotNull()).groupBy(concept, "language").agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = require_small_groups(materialize(sizes, "sizes"), [concept], MAX_TAXA, "languages")
    a = sizes.select(concept, F.col("language").alias("language_a"), F.col("n").alias("n_a"))
    b = sizes.select(concept, F.col("language").alias("language_b"), F.col("n").alias("n_b"))
    met = a.join(b, concept).filter(F.col("language_a") < F.col("language_b"))
    return met.select(concept, "language_a", "language_b", (F.col("n_a") * F.col("n_b")).alias("pairs"))


def unscored_pairs(entries: DataFrame, differences: DataFrame) -> DataFrame:
    """How many cross-language pairs of each concept have no edge."""
    keys = ["concept_id", "language_a", "language_b"]
    scored = differences.groupBy(*keys).agg(F.count(F.lit(1)).alias("scored"))
    out = language_pair_sizes(entries).join(scored, keys, "left")
    scored = F.coalesce(F.col("scored"), F.lit(0))
    return out.select(*keys, "pairs", scored.alias("scored"), (F.col("pairs") - scored).alias("unscored"))


def quality_summary(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry counts and quality per source; sources without entries stay.

    Entries are reduced to one row per source before they meet the sources.
    """
    q = F.col("data_quality")
    per = entries.groupBy("source_id").agg(
        F.count("id").alias("total_entries"), F.avg(q).alias("avg_entry_quality"),
        F.count_if(q >= 0.8).alias("high_quality_count"), F.count_if(q < 0.5).alias("low_quality_count"),
        F.count("validation_errors").alias("entries_with_errors"), F.max("updated_at").alias("last_updated"),
    )
    out = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("quality").alias("source_quality")
    ).join(per, "source_id", "left")
    counts = ["total_entries", "high_quality_count", "low_quality_count", "entries_with_errors"]
    return out.fillna(0, counts)


def concept_statistics(concepts: DataFrame, entries: DataFrame) -> DataFrame:
    """Languages and mean quality of each concept's members."""
    per_language = entries.groupBy("concept_id", "language").agg(
        F.sum("data_quality").alias("q"), F.count("data_quality").alias("n")
    )
    per = per_language.groupBy("concept_id").agg(
        F.count("language").alias("num_languages"),
        F.array_sort(F.collect_set("language")).alias("languages_represented"),
        F.try_divide(F.sum("q"), F.sum("n")).alias("avg_member_quality"),
    )
    base = concepts.select(F.col("id").alias("concept_id"), "label", "size", "confidence")
    return base.join(per, "concept_id", "left").fillna(0, ["num_languages"])


def totals(**tables: DataFrame) -> DataFrame:
    """Row counts of several tables, one row each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table_name"), "count")
        out = one if out is None else out.unionByName(one)
    return out


def embedding_progress(entries: DataFrame) -> DataFrame:
    done, total = F.count("embedding"), F.count(F.lit(1))
    return entries.agg(
        done.alias("embedded"), total.alias("total"), F.round(F.try_divide(done * 100, total), 2).alias("percent")
    )


def validation_report(validated: DataFrame) -> DataFrame:
    """Frequency of each error among the invalid rows."""
    return (
        validated.select(F.explode("validation_errors").alias("error"))
        .groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    )


def coverage(languages: DataFrame, expected: DataFrame, present: DataFrame) -> DataFrame:
    """State of each language's data file.

    ``expected``: iso_code, file (null when another source serves the
    language); ``present``: file.
    """
    out = languages.join(expected, "iso_code", "left").join(
        present.select("file", F.lit(True).alias("_found")).dropDuplicates(["file"]), "file", "left"
    )
    status = (
        F.when(F.col("file").isNull(), "ALTERNATIVE").when(F.col("_found"), "COMPLETE").otherwise("MISSING")
    )
    return out.withColumn("status", status).drop("_found")


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Coverage per family and, with family null, overall."""
    missing = F.col("status") == "MISSING"
    return covered.rollup("family").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~missing).alias("with_data"),
        F.round(100.0 * F.count_if(~missing) / F.count(F.lit(1)), 1).alias("percent"),
        # Languages are a fixed dimension, so this list is short.
        F.array_sort(F.collect_list(F.when(missing, F.col("iso_code")))).alias("missing"),
    )


def unmapped_files(present: DataFrame, expected: DataFrame) -> DataFrame:
    return present.select("file").distinct().join(expected.filter("file is not null"), "file", "left_anti")


def shared_languages(members: DataFrame, set_a, set_b) -> DataFrame:
    """Languages that occur in both of two sets; ``members``: set_id, language."""
    pick = lambda s: members.filter(F.col("set_id") == s).select("language")
    return pick(set_a).intersect(pick(set_b))


def concept_samples(entries: DataFrame, n: int = 5) -> DataFrame:
    kept = entries.filter(F.col("concept_id").isNotNull())
    return first_n(kept, ["concept_id"], ["id"], n)


def update_by_id(target: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrite some columns of the rows named in ``changes`` (unique ids)."""
    new = changes.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(new, "id", "left")
    return out.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def matched_count(target: DataFrame, changes: DataFrame) -> DataFrame:
    return target.join(changes.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("updated"))


