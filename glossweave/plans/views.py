"""The views and functions of the dictionary, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossweave.operators import entries as ops

QUALITY = """
CREATE OR REPLACE TEMPORARY FUNCTION compute_entry_quality(
  etymology STRING, pos_tag STRING, has_embedding BOOLEAN, n_errors INT, definition STRING)
RETURNS DOUBLE
RETURN greatest(0D, 1D - if(etymology IS NULL, 0.1D, 0D) - if(pos_tag IS NULL, 0.1D, 0D) - if(has_embedding, 0D, 0.2D)
  - coalesce(n_errors, 0) * 0.1D - if(length(definition) < 10, 0.2D, 0D))"""

LAYERED = """
CREATE OR REPLACE TEMPORARY FUNCTION compute_layered_similarity(
  semantic DOUBLE, phonetic DOUBLE, etymological DOUBLE, weights MAP<STRING, DOUBLE>)
RETURNS DOUBLE
RETURN weights['semantic'] * semantic + weights['phonetic'] * phonetic + weights['etymological'] * etymological"""

SIMILAR = """
CREATE OR REPLACE TEMPORARY FUNCTION find_similar_entries(target STRING, most INT DEFAULT 10)
RETURNS TABLE (entry_id STRING, headword STRING, language STRING, combined_score DOUBLE)
RETURN SELECT entry_id, headword, language, combined_score FROM (
  SELECT e.id AS entry_id, e.headword, e.language, s.combined_score,
         row_number() OVER (ORDER BY s.combined_score DESC, e.id) AS place
  FROM (SELECT if(entry_a = target, entry_b, entry_a) AS other, combined_score FROM layered_similarities
        WHERE entry_a = target OR entry_b = target) s
  JOIN entries e ON e.id = s.other)
  WHERE place <= most"""


def register(
    spark: SparkSession, sources: DataFrame, entries: DataFrame, concepts: DataFrame, edges: DataFrame
) -> None:
    """Temporary views over the given tables, and three SQL functions.

    Views are computed when read, so there is nothing to refresh.
    """
    for name, df in {
        "data_sources": sources, "entries": entries, "concepts": concepts, "layered_similarities": edges,
        "data_quality_summary": ops.quality_summary(sources, entries),
        "concept_statistics": ops.concept_statistics(concepts, entries),
        "lexical_differences": ops.lexical_differences(edges, entries, concepts),
    }.items():
        df.createOrReplaceTempView(name)
    for statement in (QUALITY, LAYERED, SIMILAR):
        spark.sql(statement)
