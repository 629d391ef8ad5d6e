"""Upserts into bucketed tables, as the jobs that store entries, concepts, sets and sources run them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import concepts
from glossweave.plans.catalog.base import ENTRIES, entries, query, r6, table, upper_sql, vector_entries
from glossweave.session import scratch_path
from glossweave.sources import buckets, sinks

BUCKETS = 16


def _written(spark, label, columns, keys, *writes):
    """The table after some writes, each given as (rows, columns to overwrite, columns to touch)."""
    path = scratch_path(spark, label)
    for number, (rows, update, touch) in enumerate(writes):
        buckets.upsert_batch(spark, path, columns, rows, keys, update, BUCKETS, number, touch=touch)
    return buckets.current(spark, path, columns)


_STORED = f"""{ENTRIES},
stored AS (SELECT e.* FROM entries e SEMI JOIN labels l ON l.doc_id = e.id),
arriving AS (SELECT *, {upper_sql('headword')} AS upper_word FROM entries WHERE embedding IS NOT NULL)"""


def _stored_and_arriving(spark, sf):
    e = vector_entries(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    bare = e.join(labelled, "id", "left_semi").withColumns({"embedding": F.lit(None).cast("array<float>"), "concept_id": F.lit(None).cast("string")})
    arriving = e.filter("embedding is not null").withColumns({"headword": F.upper("headword"), "language": F.lit("xx")})
    return bare, arriving


@query("bulk_upsert", f"""
WITH {_STORED}
SELECT coalesce(s.id, a.id) AS id, coalesce(a.upper_word, s.headword) AS headword, CASE WHEN s.id IS NULL THEN 'xx' ELSE s.language END AS language,
  a.concept_id, (s.id IS NOT NULL AND a.id IS NOT NULL)::INT AS updated FROM stored s FULL JOIN arriving a ON a.id = s.id""")
def bulk_upsert(spark, sf):
    """Every field of known entries but language; their time of change is set, that of new ones is not."""
    columns = (
        "id long, headword string, ipa string, language string, definition string, etymology string, pos_tag string, "
        "embedding array<float>, concept_id string, updated_at timestamp"
    )
    bare, arriving = _stored_and_arriving(spark, sf)
    update = [c for c in sinks.BULK_UPDATES if c in arriving.columns]
    out = _written(spark, "bulk", columns, ["id"], (bare, update, None), (arriving, update, {"updated_at": F.current_timestamp()}))
    return out.select("id", "headword", "language", "concept_id", F.col("updated_at").isNotNull().cast("int").alias("updated"))


@query("narrow_upsert", f"""
WITH {_STORED}
SELECT coalesce(s.id, a.id) AS id, coalesce(s.headword, a.upper_word) AS headword, a.concept_id, coalesce(len(a.embedding), 0)::INT AS dims
FROM stored s FULL JOIN arriving a ON a.id = s.id""")
def narrow_upsert(spark, sf):
    """Vector and concept of known entries; their words stay as they were."""
    bare, arriving = _stored_and_arriving(spark, sf)
    columns = "id long, headword string, embedding array<float>, concept_id string"
    out = _written(spark, "narrow", columns, ["id"], (bare, sinks.ASSIGNMENT_UPDATES, None), (arriving, sinks.ASSIGNMENT_UPDATES, None))
    return out.select("id", "headword", "concept_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"))


@query("concept_upsert", f"""
WITH {ENTRIES}, v AS (SELECT * FROM entries WHERE concept_id IS NOT NULL),
cells AS (SELECT concept_id, i, avg(embedding[i]) AS x FROM v, range(1, 65) r(i) GROUP BY concept_id, i),
centers AS (SELECT concept_id, list(x ORDER BY i) AS centroid FROM cells GROUP BY concept_id)
SELECT concept_id AS id, coalesce(min(headword) FILTER (id % 2 = 0), min(headword)) AS label, count(*) AS size,
  round(avg(list_cosine_similarity(embedding, centroid)), 6) AS confidence, round(any_value(centroid[1]), 6) AS first_value
FROM v JOIN centers USING (concept_id) GROUP BY concept_id""")
def concept_upsert(spark, sf):
    """Concepts of the even entries, then of all: centroid, size and confidence change, the label stays."""
    e = vector_entries(spark, sf).filter("concept_id is not null")

    def rows(some):
        labels = some.groupBy("concept_id").agg(F.min("headword").alias("label"))
        centers = concepts.centroids(some)
        return centers.join(concepts.cohesion(some, centers), "concept_id").join(labels, "concept_id").withColumnRenamed("concept_id", "id")

    columns = "id string, label string, centroid array<double>, size long, confidence double"
    out = _written(
        spark, "concepts", columns, ["id"],
        (rows(e.filter("id % 2 = 0")), sinks.CONCEPT_UPDATES, None), (rows(e), sinks.CONCEPT_UPDATES, None),
    )
    return out.select("id", "label", "size", r6("confidence"), F.round(F.col("centroid")[0], 6).alias("first_value"))


@query("cognate_set_upsert", f"""
WITH {ENTRIES}, e AS (SELECT *, 'cognate_set_' || ipa AS set_id FROM entries WHERE ipa <> '')
SELECT set_id AS id, md5(arg_min(definition, id)) AS core_md5,
  count(*) AS size, round(count(DISTINCT language)::DOUBLE / count(*), 6) AS confidence,
  coalesce(min(id) FILTER (language IN ('de', 'en')), min(id)) AS first_member FROM e GROUP BY set_id""")
def cognate_set_upsert(spark, sf):
    """Sets of one form, of two languages and then of all: all that a set says changes, its first member of old stays."""
    e = entries(spark, sf).filter("ipa <> ''").withColumn("set_id", F.concat(F.lit("cognate_set_"), "ipa"))

    def rows(some):
        return some.groupBy(F.col("set_id").alias("id")).agg(
            F.count(F.lit(1)).alias("size"), (F.count_distinct("language") / F.count(F.lit(1))).alias("confidence"),
            F.min_by("definition", "id").alias("semantic_core"), F.min("id").alias("first_member"),
        )

    columns = "id string, size long, confidence double, semantic_core string, first_member long"
    update = sinks.SET_UPDATES
    out = _written(spark, "sets", columns, ["id"], (rows(e.filter("language in ('de', 'en')")), update, None), (rows(e), update, None))
    return out.select("id", F.md5("semantic_core").alias("core_md5"), "size", r6("confidence"), "first_member")


@query("source_upsert", """
SELECT source AS id, 'all of ' || source AS name, count(*)::VARCHAR AS version,
  CASE WHEN min(doc_id) FILTER (doc_id % 3 = 0) IS NULL THEN 'late' ELSE 'early' END AS kind FROM documents GROUP BY source""")
def source_upsert(spark, sf):
    """Sources seen in a third of the documents, then in all: name and version change, the kind stays."""
    docs = table(spark, sf, "documents")

    def rows(some, name, kind):
        return some.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).cast("string").alias("version")).select(
            "id", F.concat(F.lit(name), "id").alias("name"), "version", F.lit(kind).alias("kind"), F.current_timestamp().alias("retrieved_at")
        )

    columns = "id string, name string, version string, kind string, retrieved_at timestamp"
    out = _written(
        spark, "sources", columns, ["id"],
        (rows(docs.filter("doc_id % 3 = 0"), "part of ", "early"), sinks.SOURCE_UPDATES, None),
        (rows(docs, "all of ", "late"), sinks.SOURCE_UPDATES, None),
    )
    return out.select("id", "name", "version", "kind")
