"""Duplicates, filters, table writes, totals, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import rules
from glossweave.operators import dedup, entries as ops, windows
from glossweave.plans import ingest
from glossweave.plans.catalog.base import ENTRIES, TREE, concept_table, entries, query, table, upper_sql, vector_entries
from glossweave.functions.tree import languages
from glossweave.sources import sinks


@query("dedup_keep_first", f"""
WITH {ENTRIES} SELECT id, headword, language FROM entries
QUALIFY row_number() OVER (PARTITION BY headword, language ORDER BY id) = 1""")
def dedup_keep_first(spark, sf):
    return dedup.keep_first(entries(spark, sf).select("id", "headword", "language"), ["headword", "language"], ["id"])


@query("duplicate_pairs", f"""
WITH {ENTRIES}, f AS (SELECT id, min(id) OVER (PARTITION BY headword, language) AS first FROM entries)
SELECT first, id AS duplicate FROM f WHERE id > first""")
def duplicate_pairs(spark, sf):
    return dedup.duplicate_pairs(entries(spark, sf), ["headword", "language"], "id")


@query("duplicate_texts", """
WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)
SELECT first, doc_id AS duplicate FROM f WHERE doc_id > first""")
def duplicate_texts(spark, sf):
    return dedup.duplicate_pairs(table(spark, sf, "documents"), ["text"], "doc_id")


@query("quality_gate", f"""
WITH {ENTRIES}
SELECT id, (length(definition) >= 10)::INT AS open_gate, (length(definition) >= 5)::INT AS low_gate,
       (trim(ipa) <> '' AND length(definition) >= 10)::INT AS ipa_gate
FROM entries WHERE trim(headword) <> '' AND length(definition) >= 5""")
def quality_gate(spark, sf):
    flag = lambda **kw: rules.passes_gate(**kw).cast("int")
    e = entries(spark, sf).filter(rules.passes_gate(min_definition=5))
    return e.select(
        "id", flag().alias("open_gate"), flag(min_definition=5).alias("low_gate"), flag(require_ipa=True).alias("ipa_gate")
    )


@query("entry_filter", f"WITH {ENTRIES} SELECT id, headword, pos_tag FROM entries WHERE language = 'en' AND pos_tag = 'noun'")
def entry_filter(spark, sf):
    return ops.query(entries(spark, sf), language="en", pos_tag="noun").select("id", "headword", "pos_tag")


@query("branch_filter", f"WITH {ENTRIES} SELECT id, headword, language FROM entries WHERE language IN ('de', 'en')")
def branch_filter(spark, sf):
    return ops.in_branch(entries(spark, sf), "germanic").select("id", "headword", "language")


@query("branch_counts", f"""
WITH {ENTRIES}, {TREE}
SELECT branch, count(*) AS entries FROM entries JOIN tree ON code = language GROUP BY branch""")
def branch_counts(spark, sf):
    dim = F.broadcast(languages(spark).select(F.col("iso_code").alias("language"), "branch"))
    return entries(spark, sf).join(dim, "language").groupBy("branch").agg(F.count(F.lit(1)).alias("entries"))


@query("resume_scan", f"""
WITH {ENTRIES} SELECT id, headword, source_id FROM entries
WHERE source_id = 'src7' AND id > (SELECT avg(doc_id) FROM documents)""")
def resume_scan(spark, sf):
    middle = table(spark, sf, "documents").agg(F.avg("doc_id")).first()[0]
    return ops.scan(entries(spark, sf), source_id="src7", resume_from=middle).select("id", "headword", "source_id")


@query("entry_page", f"WITH {ENTRIES} SELECT id, headword, language FROM entries ORDER BY headword DESC, id LIMIT 25 OFFSET 50")
def entry_page(spark, sf):
    return ops.page(entries(spark, sf), [F.desc("headword"), "id"], 25, 50).select("id", "headword", "language")


@query("quality_tiers", f"""
WITH {ENTRIES}, q AS (
  SELECT id, 1e0 - CASE WHEN etymology IS NULL THEN 0.1e0 ELSE 0e0 END - CASE WHEN pos_tag IS NULL THEN 0.1e0 ELSE 0e0 END
       - CASE WHEN embedding IS NULL THEN 0.2e0 ELSE 0e0 END - 0 * 0.1e0 - CASE WHEN length(definition) < 10 THEN 0.2e0 ELSE 0e0 END AS q FROM entries)
SELECT CASE WHEN q > 0.8e0 THEN 'high' WHEN q >= 0.5e0 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM q GROUP BY tier""")
def quality_tiers(spark, sf):
    q = rules.entry_quality(F.col("etymology"), F.col("pos_tag"), F.col("embedding"), F.lit(0), F.col("definition"))
    return vector_entries(spark, sf).groupBy(rules.quality_tier(q).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("missing_vectors", f"WITH {ENTRIES} SELECT id, language FROM entries WHERE embedding IS NULL")
def missing_vectors(spark, sf):
    return ops.missing_embedding(vector_entries(spark, sf)).select("id", "language")


@query("embedding_progress", f"""
WITH {ENTRIES} SELECT count(embedding) AS embedded, count(*) AS total, round(100e0 * count(embedding) / count(*), 2) AS percent FROM entries""")
def embedding_progress(spark, sf):
    return ops.embedding_progress(vector_entries(spark, sf))


@query("table_totals", f"""
WITH {ENTRIES} SELECT 'raw' AS table_name, count(*) AS count FROM documents
UNION ALL SELECT 'entries', count(*) FROM entries
UNION ALL SELECT 'without_vector', count(*) FROM entries WHERE embedding IS NULL""")
def table_totals(spark, sf):
    e = vector_entries(spark, sf)
    return ops.totals(raw=table(spark, sf, "documents"), entries=e, without_vector=ops.missing_embedding(e))


_STATS_SQL = f"""
WITH {ENTRIES}
SELECT e.concept_id, upper(e.concept_id) AS label, count(*) AS size, count(DISTINCT language) AS num_languages,
       array_to_string(list_sort(list_distinct(list(language))), ',') AS languages,
       round(avg(1e0 - CASE WHEN etymology IS NULL THEN 0.1e0 ELSE 0e0 END - CASE WHEN pos_tag IS NULL THEN 0.1e0 ELSE 0e0 END
         - CASE WHEN length(definition) < 10 THEN 0.2e0 ELSE 0e0 END), 6) AS avg_member_quality
FROM entries e WHERE concept_id IS NOT NULL GROUP BY concept_id"""


@query("concept_statistics", _STATS_SQL)
def concept_statistics(spark, sf):
    q = rules.entry_quality(F.col("etymology"), F.col("pos_tag"), F.col("embedding"), F.lit(0), F.col("definition"))
    e = vector_entries(spark, sf).withColumn("data_quality", q)
    concepts = concept_table(spark, sf).withColumn("confidence", F.lit(1.0))
    out = ops.concept_statistics(concepts, e)
    return out.select(
        "concept_id", "label", "size", "num_languages", F.array_join("languages_represented", ",").alias("languages"),
        F.round("avg_member_quality", 6).alias("avg_member_quality"),
    )


@query("top_concepts", f"""
WITH {ENTRIES} SELECT concept_id AS id, count(*) AS size FROM entries WHERE concept_id IS NOT NULL
GROUP BY concept_id ORDER BY size DESC, id LIMIT 5""")
def top_concepts(spark, sf):
    return concept_table(spark, sf).select("id", "size").orderBy(F.desc("size"), "id").limit(5)


@query("concept_by_label", f"""
WITH {ENTRIES} SELECT concept_id AS id, count(*) AS size FROM entries WHERE upper(concept_id) ILIKE '%cept_000%'
GROUP BY concept_id ORDER BY size DESC, id LIMIT 1""")
def concept_by_label(spark, sf):
    return ops.concept_by_label(concept_table(spark, sf), "cept_000").select("id", "size")


@query("concept_entries", f"""
WITH {ENTRIES} SELECT id, headword FROM entries WHERE concept_id = 'concept_0001' AND language = 'en' ORDER BY id LIMIT 5""")
def concept_entries(spark, sf):
    return ops.concept_entries(vector_entries(spark, sf), "concept_0001", "en", 5).select("id", "headword")


@query("concept_samples", f"""
WITH {ENTRIES} SELECT concept_id, id, row_number() OVER (PARTITION BY concept_id ORDER BY id)::INT AS rank FROM entries
WHERE concept_id IS NOT NULL QUALIFY rank <= 5""")
def concept_samples(spark, sf):
    return ops.concept_samples(vector_entries(spark, sf)).select("concept_id", "id", "rank")


def _stored(spark, sf):
    """The table before a write: entries that have a label row."""
    return entries(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")


def _arriving(spark, sf):
    """The rows of a write: entries that have an embedding row, upper-cased."""
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return entries(spark, sf).join(ids, "id", "left_semi").withColumns(
        {"headword": F.upper("headword"), "language": F.lit("xx")}
    )


_BOTH = f"""{ENTRIES},
stored AS (SELECT e.* FROM entries e SEMI JOIN labels l ON l.doc_id = e.id),
arriving AS (SELECT id, upper(headword) AS headword, 'xx' AS language, source_id FROM entries WHERE embedding IS NOT NULL)"""


@query("upsert_entries", f"""
WITH {_BOTH.replace("upper(headword)", upper_sql("headword"))}
SELECT coalesce(s.id, a.id) AS id, coalesce(a.headword, s.headword) AS headword, coalesce(s.language, a.language) AS language
FROM stored s FULL JOIN arriving a ON a.id = s.id""")
def upsert_entries(spark, sf):
    out = sinks.upsert(_stored(spark, sf), _arriving(spark, sf), ["id"], ["headword", "ipa"])
    return out.select("id", "headword", "language")


@query("upsert_last_wins", """
SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id""")
def upsert_last_wins(spark, sf):
    """Writes every turn into a table keyed by conversation; the last turn stays."""
    talk = table(spark, sf, "conversations")
    base = talk.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("role"))
    return sinks.upsert(base, talk.select("conv_id", "turn", "role"), ["conv_id"], ["role"], order=["turn"])


@query("update_vectors", f"""
WITH {_BOTH} SELECT id, CASE WHEN embedding IS NULL THEN 0 ELSE len(embedding) END::INT AS dims FROM stored""")
def update_vectors(spark, sf):
    bare = _stored(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
    new = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = ops.update_by_id(bare, new, ["embedding"])
    return out.select("id", F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"))


@query("updated_count", f"WITH {_BOTH} SELECT count(*) AS updated FROM stored WHERE embedding IS NOT NULL")
def updated_count(spark, sf):
    return ops.matched_count(_stored(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query("append_new_raw", """
WITH t AS (SELECT doc_id, sha256(text) AS checksum FROM documents),
known AS (SELECT checksum FROM t SEMI JOIN labels l ON l.doc_id = t.doc_id)
SELECT min(doc_id) AS doc_id, checksum FROM t WHERE checksum NOT IN (SELECT checksum FROM known) GROUP BY checksum""")
def append_new_raw(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    known = raw.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return sinks.append_new(known, raw, ["checksum"], ["doc_id"]).select("doc_id", "checksum")


@query("delete_ids", f"WITH {_BOTH} SELECT id, headword FROM stored WHERE embedding IS NULL")
def delete_ids(spark, sf):
    gone = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return sinks.delete_ids(_stored(spark, sf), gone).select("id", "headword")


@query("delete_source", f"WITH {ENTRIES} SELECT source_id, count(*) AS n FROM entries WHERE source_id <> 'src7' GROUP BY source_id")
def delete_source(spark, sf):
    return sinks.delete_source(entries(spark, sf), "src7").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("missing_languages", """
SELECT 'n' || n_nationkey AS iso_code, min(n_name) AS name, 'Unknown' AS branch
FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
  AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) GROUP BY n_nationkey""")
def missing_languages(spark, sf):
    code = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    nations = table(spark, sf, "nation").select(code("n_nationkey").alias("lang_code"), F.col("n_name").alias("lang"))
    used = table(spark, sf, "customer").select(code("c_nationkey").alias("lang_code")).join(nations, "lang_code")
    known = table(spark, sf, "supplier").filter("s_acctbal > 9000").select(code("s_nationkey").alias("iso_code"))
    return sinks.missing_languages(used, known).select("iso_code", "name", "branch")


@query("sliding_windows", """
WITH w AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS start, list(event_type) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS items FROM events)
SELECT start, array_to_string(items, '>') AS items FROM w WHERE len(items) = 4""")
def sliding_windows(spark, sf):
    out = windows.sliding_windows(table(spark, sf, "events"), ["event_id"], "event_type", 4, block=1000)
    return out.select("start", F.array_join("items", ">").alias("items"))


@query("event_batches", """
WITH b AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS batch_id, value FROM events)
SELECT batch_id, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY batch_id""")
def event_batches(spark, sf):
    out = windows.batches(table(spark, sf, "events").select("ts", "event_id", "value"), ["ts", "event_id"], 500)
    return out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("shared_languages", """
SELECT lang AS language FROM documents WHERE source = 'src0' INTERSECT SELECT lang FROM documents WHERE source = 'src1'""")
def shared_languages(spark, sf):
    members = table(spark, sf, "documents").select(F.col("source").alias("set_id"), F.col("lang").alias("language"))
    return ops.shared_languages(members, "src0", "src1")


@query("typed_entries", rf"""
WITH {ENTRIES}, c AS (
  SELECT id AS doc, lower(headword) AS headword, language,
    trim(regexp_replace(lower(nfc_normalize(trim(regexp_replace(regexp_replace(regexp_replace(definition, '\[\d+\]', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))), '\s+', ' ', 'g')) AS definition
  FROM entries), u AS (
  SELECT * FROM c WHERE headword <> '' AND length(definition) >= 10
  QUALIFY row_number() OVER (PARTITION BY headword, language ORDER BY doc) = 1)
SELECT doc, headword, language, 'entry_' || substring(sha256(headword || language || definition), 1, 16) AS id FROM u""")
def typed_entries(spark, sf):
    out = ingest.typed_entries(entries(spark, sf).withColumn("doc", F.col("id")), ["doc"])
    return out.select("doc", "headword", "language", "id")


@query("ingest_counts", f"""
WITH {ENTRIES}, g AS (SELECT *, length(definition) >= 10 AS good FROM entries)
SELECT count(*) AS loaded, count(*) FILTER (NOT good) AS gated,
  count(*) FILTER (good) - count(DISTINCT (lower(headword), language)) FILTER (good) AS duplicates,
  count(DISTINCT (lower(headword), language)) FILTER (good) AS saved FROM g""")
def ingest_counts(spark, sf):
    """Run counters as aggregates over the stages of one run."""
    loaded = entries(spark, sf)
    good = rules.passes_gate()
    flags = loaded.select(F.lower("headword").alias("headword"), "language", good.alias("good"))
    per = flags.groupBy("headword", "language").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("ok"))
    return per.agg(
        F.sum("n").alias("loaded"), F.sum(F.col("n") - F.col("ok")).alias("gated"),
        F.sum(F.greatest(F.col("ok") - 1, F.lit(0))).alias("duplicates"), F.count_if(F.col("ok") > 0).alias("saved"),
    )
