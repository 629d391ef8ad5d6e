"""Vectors, concepts and plot coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import concepts as ops, density, vector_index
from glossweave.operators.entries import search_vectors
from glossweave.plans import layout
from glossweave.plans.catalog.base import ENTRIES, FIRST_WORDS, entries, query, r6, table, upper_sql, vector_entries
from glossweave.session import scratch_path

_VECTORS = f"""{ENTRIES}, v AS (SELECT * FROM entries WHERE embedding IS NOT NULL)"""

_CENTERS = f"""{_VECTORS},
cells AS (SELECT concept_id, i, avg(embedding[i]) AS x, count(*) AS size FROM v, range(1, 65) r(i) GROUP BY concept_id, i),
centers AS (SELECT concept_id, list(x ORDER BY i) AS centroid, max(size) AS size FROM cells GROUP BY concept_id)"""


@query("vector_topk", f"""
WITH {_VECTORS}, q AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings)
SELECT id, round(list_cosine_similarity(embedding, e), 6) AS similarity FROM v, q
WHERE list_cosine_similarity(embedding, e) >= 0.1 ORDER BY list_cosine_similarity(embedding, e) DESC, id LIMIT 10""")
def vector_topk(spark, sf):
    target = table(spark, sf, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0]
    out = search_vectors(vector_entries(spark, sf), list(map(float, target)), 10, 0.1)
    return out.select("id", r6("similarity"))


@query("vector_index_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 3),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], e) AS c FROM embeddings, q)
SELECT query_id, id, round(c, 6) AS similarity FROM s WHERE c >= 0.1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= 10""")
def vector_index_topk(spark, sf):
    """Three searches in the index of all vectors."""
    rows = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    path = scratch_path(spark, "index")
    vector_index.build_index(rows, path, cells=64)
    out = None
    for r in rows.orderBy("id").limit(3).collect():
        found, _ = vector_index.search_index(spark, path, list(map(float, r.embedding)), 10, 0.1)
        found = found.select(F.lit(r.id).alias("query_id"), "id", r6("similarity"))
        out = found if out is None else out.unionByName(found)
    return out


@query("centroids", f"""
WITH {_CENTERS} SELECT concept_id, i::INT AS pos, round(x, 6) AS value, size FROM cells""")
def centroids(spark, sf):
    out = ops.centroids(vector_entries(spark, sf))
    long = out.select("concept_id", "size", F.posexplode("centroid").alias("at", "value"))
    return long.select("concept_id", (F.col("at") + 1).alias("pos"), r6("value"), "size")


@query("cluster_confidence", f"""
WITH {_CENTERS}
SELECT concept_id, round(avg(list_cosine_similarity(embedding, centroid)), 6) AS confidence
FROM v JOIN centers USING (concept_id) GROUP BY concept_id""")
def cluster_confidence(spark, sf):
    e = vector_entries(spark, sf).select("id", "embedding", "concept_id")
    return ops.cohesion(e, ops.centroids(e)).select("concept_id", r6("confidence"))


@query("assign_concepts", f"""
WITH {_CENTERS}, d AS (
  SELECT v.id, c.concept_id, list_cosine_similarity(v.embedding, c.centroid) AS s FROM v, centers c)
SELECT id, arg_min(concept_id, (-round(s, 12), concept_id)) AS concept_id, round(max(s), 6) AS confidence FROM d GROUP BY id""")
def assign_concepts(spark, sf):
    e = vector_entries(spark, sf)
    out = ops.assign(e.drop("concept_id"), ops.centroids(e))
    return out.select("id", "concept_id", r6("confidence"))


@query("concept_profile", f"""
WITH {_CENTERS}, f AS (
  SELECT concept_id, array_to_string(list(id ORDER BY id)[1:5], ',') AS firsts, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages,
         arg_min(definition, id) AS d FROM v GROUP BY concept_id)
SELECT concept_id, size, languages, md5(d) AS first_md5,
       {upper_sql(FIRST_WORDS)} AS label
FROM centers JOIN f USING (concept_id)""")
def concept_profile(spark, sf):
    out = ops.profile(vector_entries(spark, sf))
    return out.select(
        "concept_id", "size", F.array_join("languages", ",").alias("languages"),
        F.md5(F.col("sample_definitions")[0]).alias("first_md5"), "label",
    )


@query("hashed_vectors")
def hashed_vectors(spark, sf):
    out = ops.hashed_vectors(entries(spark, sf).select("id", "definition"), "definition", 64)
    return out.select("id", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.round(x, 5)).cast("string").alias("v"))


@query("embed_missing", f"""
WITH {ENTRIES} SELECT count(*) AS entries, count(*) AS with_vector,
  (SELECT count(DISTINCT definition) FROM entries WHERE embedding IS NULL) AS new_texts FROM entries""")
def embed_missing(spark, sf):
    e = vector_entries(spark, sf).select("id", "definition", "embedding")
    filled = ops.embed_missing(e, lambda df, c: ops.hashed_vectors(df, c, 64))
    texts = e.filter("embedding is null").agg(F.count_distinct("definition").alias("new_texts"))
    counted = filled.agg(F.count(F.lit(1)).alias("entries"), F.count("embedding").alias("with_vector"))
    one = F.lit(1).alias("one")
    return counted.select("*", one).join(texts.select("*", one), "one").drop("one")


@query("density_concepts")
def density_concepts(spark, sf):
    found = ops.density_concepts(vector_entries(spark, sf), dims=2, min_samples=5, min_size=5)
    return found.groupBy("concept_id").agg(F.count(F.lit(1)).alias("size"))


@query("density_clusters", """
WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1:2]::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON list_distance(a.v, b.v) <= 0.035e0 + 1e-12),
core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 10),
links AS (SELECT n.id, n.other FROM near n SEMI JOIN core a ON a.id = n.id SEMI JOIN core b ON b.id = n.other),
reach AS (SELECT id, id AS root FROM core UNION SELECT l.other, r.root FROM reach r JOIN links l ON l.id = r.id),
inside AS (SELECT id, min(root) AS cluster, true AS core FROM reach GROUP BY id),
border AS (
  SELECT n.id, arg_min(i.cluster, (n.d, n.other)) AS cluster, false AS core FROM near n JOIN inside i ON i.id = n.other
  ANTI JOIN core c ON c.id = n.id GROUP BY n.id),
members AS (SELECT * FROM inside UNION ALL SELECT * FROM border)
SELECT id, cluster, core FROM members WHERE cluster IN (SELECT cluster FROM members GROUP BY cluster HAVING count(*) >= 50)""")
def density_clusters(spark, sf):
    """Density clusters of all vectors on their first two coordinates."""
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 2).alias("reduced"))
    return density.density_clusters(points, 0.035)


@query("neighbour_concepts")
def neighbour_concepts(spark, sf):
    found = ops.neighbour_concepts(vector_entries(spark, sf), 0.05)
    return found.groupBy("concept_id").agg(F.count(F.lit(1)).alias("size"))


@query("kmeans_concepts")
def kmeans_concepts(spark, sf):
    found = ops.kmeans_concepts(vector_entries(spark, sf), k=10, min_size=5)
    return found.groupBy("concept_id").agg(F.count(F.lit(1)).alias("size"))


@query("language_space")
def language_space(spark, sf):
    points, _ = layout.language_space(vector_entries(spark, sf), 3)
    return points.select("id", "language", "headword", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("concept_map")
def concept_map(spark, sf):
    e = vector_entries(spark, sf)
    points, _ = layout.concept_map(ops.profile(e), e, 2)
    return points.select("kind", "concept", "label", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("language_similarity", f"""
WITH {_VECTORS}, u AS (SELECT language, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM v)
SELECT a.language AS a, b.language AS b, round(avg(list_dot_product(a.e, b.e)), 6) AS similarity
FROM u a JOIN u b ON a.language < b.language GROUP BY ALL""")
def language_similarity(spark, sf):
    """Mean cosine of all cross-language pairs, without forming a pair."""
    return ops.language_similarity(vector_entries(spark, sf)).select("a", "b", r6("similarity"))
