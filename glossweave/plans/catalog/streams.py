"""Streaming jobs over the given tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import concepts
from glossweave.operators.dedup import keep_first, keep_last
from glossweave.plans import ingest
from glossweave.functions.text import LANGUAGE_NAMES
from glossweave.functions.vectors import unit
from glossweave.plans.catalog.base import ENTRIES, as_entries, query, r6, table, vector_entries
from glossweave.session import materialize, scratch_path, share
from glossweave.streaming import chain, jobs


def _documents(spark, sf):
    return jobs.table_stream(spark, f"{sf}/documents*.parquet")


def _events(spark, sf):
    return jobs.table_stream(spark, f"{sf}/events*.parquet")


@query("stream_clean", f"""
WITH {ENTRIES} SELECT id, lower(headword) AS headword, language,
  round(1e0 - CASE WHEN etymology IS NULL THEN 0.1e0 ELSE 0e0 END - CASE WHEN pos_tag IS NULL THEN 0.1e0 ELSE 0e0 END - 0.2e0, 6) AS data_quality
FROM entries WHERE length(definition) >= 10""")
def stream_clean(spark, sf):
    docs = as_entries(_documents(spark, sf))
    out = jobs.stream_through(jobs.clean_stream(docs, tasks=spark.sparkContext.defaultParallelism), "clean")
    return out.select("id", "headword", "language", F.round("data_quality", 6).alias("data_quality"))


@query("stream_dedup", f"WITH {ENTRIES} SELECT DISTINCT headword, language FROM entries")
def stream_dedup(spark, sf):
    e = as_entries(_documents(spark, sf)).select("headword", "language")
    return jobs.stream_through(jobs.first_per_key(e, ["headword", "language"]), "dedup")


@query("stream_dedup_bounded", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_bounded(spark, sf):
    """Watermarked form; the delay spans the table, so no key may come twice."""
    ev = _events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    out = jobs.first_per_key(ev, ["user_id", "event_type"], "ts", "400 days")
    return jobs.stream_through(out.select("user_id", "event_type"), "bounded")


@query("stream_filter", "SELECT event_id, value * 2 AS value FROM events WHERE event_type = 'click'")
def stream_filter(spark, sf):
    ev = _events(spark, sf).filter("event_type = 'click'").select("event_id", (F.col("value") * 2).alias("value"))
    return jobs.stream_through(ev, "filter")


@query("stream_resume", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_resume(spark, sf):
    """Two runs over the same files; the second meets only what it already stored."""
    path = scratch_path(spark, "resume")
    for _ in range(2):
        ev = _events(spark, sf).select("event_id", "user_id", "event_type")
        handle = jobs.store_new(path, ["user_id", "event_type"], ["event_id"])
        jobs.run_batches(ev, handle, f"{path}-state").awaitTermination()
    return spark.read.parquet(path).select("user_id", "event_type", "event_id")


@query("stream_json", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def stream_json(spark, sf):
    """Events written as JSON lines and streamed back in micro-batches."""
    path = scratch_path(spark, "json-lines")
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    ev.repartition(4).write.option("compression", "gzip").json(path)
    out = jobs.stream_through(jobs.json_stream(spark, path, ev.schema, files_per_batch=1), "json")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_first_events", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_first_events(spark, sf):
    """Stream to a table, then keep the first row per key in batch."""
    out = jobs.stream_through(_events(spark, sf).select("event_id", "user_id"), "events")
    return keep_first(out, ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("stream_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark, sf):
    """Events in micro-batches as upserts of one row per user; the newest stays."""
    source, path = scratch_path(spark, "upsert-in"), scratch_path(spark, "upsert")
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    ev.repartitionByRange(4, "event_id").write.json(source)
    store = jobs.store_changes(path)

    def newest(batch, number):
        store(keep_last(batch, ["user_id"], ["event_id"]), number)

    stream = jobs.json_stream(spark, source, ev.schema, files_per_batch=1)
    jobs.run_batches(stream, newest, f"{path}-state").awaitTermination()
    # Files may arrive in any order, so the newest event decides, not the newest batch.
    rows = spark.read.parquet(path).select("user_id", "event_type", "event_id")
    return keep_last(rows, ["user_id"], ["event_id"])


def letter_vectors(df, text, out="embedding"):
    """Shares of the letters a to z: a model small enough to be written in SQL."""
    letters = F.array(*[F.length(text) - F.length(F.replace(F.col(text), F.lit(c))) for c in map(chr, range(97, 123))])
    return df.withColumn(out, unit(letters).cast("array<float>"))


_CHAIN = rf"""
WITH {ENTRIES}, c AS (
  SELECT id AS doc, lower(headword) AS headword, language, source_id, etymology IS NULL AS no_etymology, pos_tag IS NULL AS no_tag,
    trim(regexp_replace(lower(nfc_normalize(trim(regexp_replace(regexp_replace(regexp_replace(definition, '\[\d+\]', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))), '\s+', ' ', 'g')) AS definition,
    concept_id
  FROM entries),
l AS (
  SELECT *, list_transform(range(97, 123), lambda x: length(definition) - length(replace(definition, chr(x::INT), ''))) AS n FROM c
  WHERE headword <> '' AND length(definition) >= 10),
v AS (SELECT *, list_transform(list_transform(n, lambda x: CASE WHEN list_sum(n) = 0 THEN 0 ELSE x / sqrt(list_dot_product(n::DOUBLE[], n::DOUBLE[])) END), lambda x: x::FLOAT) AS e FROM l),
cells AS (SELECT concept_id, i, avg(e[i]::DOUBLE) AS x FROM v, range(1, 27) r(i) WHERE concept_id IS NOT NULL GROUP BY concept_id, i),
centers AS (SELECT concept_id, list(x ORDER BY i) AS centroid FROM cells GROUP BY concept_id),
u AS (SELECT *, 'entry_' || substring(sha256(headword || language || definition), 1, 16) AS id FROM v
  QUALIFY row_number() OVER (PARTITION BY headword, language, definition ORDER BY doc DESC) = 1),
d AS (SELECT u.id, c.concept_id, list_cosine_similarity(u.e::DOUBLE[], c.centroid) AS s FROM u, centers c),
b AS (SELECT id, arg_min(concept_id, (-round(s, 12), concept_id)) AS concept_id, round(max(s), 6) AS confidence FROM d GROUP BY id)
"""


def _chained(spark, sf, arrivals, buckets):
    """Documents that arrive in ranges of ascending ids, one per micro-batch, through the chain into a bucketed table."""
    source, path, progress = (scratch_path(spark, n) for n in ("chain-in", "chain", "chain-progress"))
    docs = table(spark, sf, "documents")
    known = letter_vectors(ingest.clean_entries(vector_entries(spark, sf).filter("concept_id is not null")).filter("length(definition) >= 10"), "definition")
    handler = chain.Chain(path, materialize(concepts.centroids(known), "centers"), letter_vectors, ("doc",), buckets, progress=progress)
    # Large inputs arrive in files enough for all cores.
    cores = spark.sparkContext.defaultParallelism
    small = docs.rdd.getNumPartitions() < cores
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = 1 if low is None else (high - low) // arrivals + 1
    number = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / width), F.lit(0))
    for n in range(arrivals):
        # What has arrived, however many files it takes, is one micro-batch; the next run goes on behind it.
        docs.filter(number == n).write.mode("append").parquet(source)
        arriving = as_entries(jobs.table_stream(spark, f"{source}/*.parquet", files_per_batch=(1 << 31) - 1))
        arriving = arriving.withColumn("doc", F.col("id"))
        chain.run_chain(arriving.repartition(cores) if small else arriving, handler, f"{path}-state")
    return path, progress


@query("stream_chain", f"""{_CHAIN}
SELECT id, headword, language, b.concept_id, confidence,
  round(1e0 - CASE WHEN no_etymology THEN 0.1e0 ELSE 0e0 END - CASE WHEN no_tag THEN 0.1e0 ELSE 0e0 END, 6) AS data_quality
FROM u JOIN b USING (id)""")
def stream_chain(spark, sf):
    """Stream to an upserted table: clean, gate, embed, assign, rate, upsert, in four micro-batches."""
    path, _ = _chained(spark, sf, 4, 8)
    out = chain.stored_entries(spark, path)
    return out.select("id", "headword", "language", "concept_id", F.round("concept_confidence", 6).alias("confidence"), r6("data_quality"))


# A field that the cleaners reject: no headword or letter, a definition of one or two characters, no language code.
_FAILED = rf"""(coalesce(headword, '') = '' OR NOT regexp_matches(regexp_replace(headword, '[\p{{M}}\p{{Lm}}\s]', '', 'g'), '\p{{L}}')
  OR NOT coalesce(regexp_matches(definition, '(?s)\S.+\S'), false) OR NOT coalesce(regexp_matches(lower(trim(language)), '^[a-z]{{2,3}}$')
  OR lower(trim(language)) IN ({', '.join(f"'{n}'" for n in LANGUAGE_NAMES)}), false))"""


@query("stream_progress", f"""{_CHAIN}
SELECT count(*) AS processed, count(*) FILTER ({_FAILED}) AS failed,
  count(*) FILTER (NOT {_FAILED} AND length(definition) < 10) AS skipped, 2::BIGINT AS batches FROM c""")
def stream_progress(spark, sf):
    """Counts of the chain's batches, summed from the table that the batches write."""
    _, progress = _chained(spark, sf, 2, 4)
    return chain.progress_totals(spark, progress).select("processed", "failed", "skipped", "batches")


@query("full_run")
def full_run(spark, sf):
    """Clean, gate, deduplicate, embed what has no vector, assign and rate all entries."""
    e = vector_entries(spark, sf)
    out = ingest.full_run(
        e.drop("concept_id"), ["id"], concepts.centroids(e), lambda df, c: concepts.hashed_vectors(df, c, 64)
    )
    return out.select(
        "id", "headword", "language", "concept_id", F.round("concept_confidence", 4).alias("confidence"),
        F.round("data_quality", 4).alias("data_quality"),
    )
