"""Cleaning, validation, ids and JSON access."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import ids, rules, text as tx
from glossweave.operators import entries as ops
from glossweave.plans import cleaning, ingest
from glossweave.plans.catalog.base import ENTRIES, FIRST_WORDS, RECORDS, entries, query, r6, records, table, upper_sql, vector_entries

_QUALITY_SQL = """greatest(0e0, 1e0 - CASE WHEN etymology IS NULL THEN 0.1e0 ELSE 0e0 END
  - CASE WHEN pos_tag IS NULL THEN 0.1e0 ELSE 0e0 END - CASE WHEN embedding IS NULL THEN 0.2e0 ELSE 0e0 END
  - coalesce(len(errors), 0) * 0.1e0 - CASE WHEN length(definition) < 10 THEN 0.2e0 ELSE 0e0 END)"""

_CODES = ", ".join(f"'{c}'" for c in rules.KNOWN_CODES)


def _required(f):
    return f"CASE WHEN {f} IS NULL OR trim({f}, ' ' || chr(10) || chr(9)) = '' THEN '{f} is required' END"


def _least(f, n):
    return f"CASE WHEN length(coalesce({f}, '')) < {n} THEN '{f} must be at least {n} characters' END"


def _most(f, n):
    return f"CASE WHEN length(coalesce({f}, '')) > {n} THEN '{f} must be at most {n} characters' END"


_IPA = (
    "CASE WHEN trim(coalesce(ipa, ''), ' ' || chr(10) || chr(9)) = '' THEN 'IPA transcription is empty' "
    "WHEN regexp_matches(ipa, '[0-9]') AND NOT regexp_matches(ipa, '[ː̯̥̆̊]') "
    "THEN 'IPA contains suspicious numeric characters' "
    "WHEN length(replace(ipa, '[', '')) <> length(replace(ipa, ']', '')) THEN 'IPA has unbalanced brackets' END"
)
_LANG = (
    f"CASE WHEN lower(language) NOT IN ({_CODES}) "
    "THEN 'Unknown or non-Indo-European language code: ' || lower(language) END"
)

_RULES_SQL = {
    "standard": [*map(_required, ("headword", "ipa", "language", "definition")), _least("headword", 1),
                 _least("definition", 3), _most("headword", 255), _most("ipa", 255), _IPA, _LANG],
    "strict": [*map(_required, ("headword", "ipa", "language", "definition", "etymology", "pos_tag")),
               _least("headword", 1), _least("definition", 10), _least("etymology", 5),
               _most("headword", 255), _most("ipa", 255), _IPA, _LANG],
    "permissive": [_required("headword"), _required("language"), _least("headword", 1)],
}


def _errors_sql(rule_set):
    return f"list_filter([{', '.join(_RULES_SQL[rule_set])}], lambda x: x IS NOT NULL)"


@query("quality_by_source", f"""
WITH {ENTRIES},
rated AS (
  SELECT e.*, ev.ts AS updated_at, {_errors_sql('standard')} AS errors FROM entries e LEFT JOIN events ev ON ev.event_id = e.id
),
scored AS (SELECT *, {_QUALITY_SQL} AS q FROM rated)
SELECT s.source AS source_id, upper(s.source) AS source_name, s.quality AS source_quality, count(q.id) AS total_entries,
       round(avg(q.q), 6) AS avg_entry_quality, count(*) FILTER (q.q >= 0.8) AS high_quality_count,
       count(*) FILTER (q.q < 0.5) AS low_quality_count, count(*) FILTER (len(q.errors) > 0) AS entries_with_errors,
       max(q.updated_at) AS last_updated
FROM (SELECT source, CASE WHEN max(quality) = 1 THEN 'reviewed' ELSE 'open' END AS quality
      FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) s
LEFT JOIN scored q ON q.source_id = s.source GROUP BY ALL""")
def quality_by_source(spark, sf):
    rated = ingest.rate(vector_entries(spark, sf))
    times = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    labelled = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    sources = labelled.groupBy(F.col("source").alias("id")).agg(
        F.when(F.max("quality") == 1, "reviewed").otherwise("open").alias("quality")
    ).withColumn("name", F.upper("id"))
    out = ops.quality_summary(sources, rated.join(times, "id", "left"))
    return out.withColumn("avg_entry_quality", F.round("avg_entry_quality", 6))


def _validated(spark, sf, rule_set):
    return records(spark, sf).withColumn("validation_errors", rules.errors(rules.RULE_SETS[rule_set]()))


def _register_validation(rule_set):
    @query(f"validate_{rule_set}", f"""
WITH {RECORDS}, checked AS (SELECT id, {_errors_sql(rule_set)} AS errors FROM records)
SELECT id, array_to_string(errors, '; ') AS errors, CASE WHEN len(errors) = 0 THEN 1 ELSE 0 END AS is_valid,
       round(CASE WHEN len(errors) = 0 THEN 1e0 ELSE 1e0 - least(0.15e0 * len(errors), 0.9e0) END, 6) AS score
FROM checked""")
    def run(spark, sf):
        n = F.size("validation_errors")
        return _validated(spark, sf, rule_set).select(
            "id", F.array_join("validation_errors", "; ").alias("errors"), (n == 0).cast("int").alias("is_valid"),
            F.round(rules.rule_score(n), 6).alias("score"),
        )

    @query(f"validation_report_{rule_set}", f"""
WITH {RECORDS}, checked AS (SELECT unnest({_errors_sql(rule_set)}) AS error FROM records)
SELECT error, count(*) AS n FROM checked GROUP BY error""")
    def report(spark, sf):
        return ops.validation_report(_validated(spark, sf, rule_set))


for _name in rules.RULE_SETS:
    _register_validation(_name)

_MARKS = r"[*†‡§¶]|\([^)]*\)"


def _squeeze(c):
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _head_sql(c):
    return _squeeze(f"nfc_normalize(regexp_replace({c}, '{_MARKS}', '', 'g'))")


def _definition_sql(c):
    return _squeeze(rf"regexp_replace(regexp_replace({c}, '\[\d+\]', '', 'g'), '<[^>]+>', '', 'g')")


@query("clean_headword", f"WITH {RECORDS} SELECT id, {_head_sql('headword')} AS headword FROM records")
def clean_headword(spark, sf):
    return records(spark, sf).select("id", tx.clean_headword(F.col("headword")).alias("headword"))


@query("clean_definition", rf"""
WITH {RECORDS}, c AS (SELECT id, {_definition_sql('definition')} AS t FROM records)
SELECT id, md5(t) AS definition_md5,
  CASE WHEN length(t) > 50 THEN regexp_replace(substring(t, 1, 50), ' [^ ]*$', '') || '...' ELSE t END AS short FROM c""")
def clean_definition(spark, sf):
    text = F.col("definition")
    return records(spark, sf).select(
        "id", F.md5(tx.clean_definition(text)).alias("definition_md5"), tx.clean_definition(text, max_length=50).alias("short")
    )


@query("normalize_text", rf"""
SELECT doc_id AS id, md5({_squeeze("lower(nfc_normalize(text))")}) AS plain_md5,
       md5({_squeeze(r"regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}\p{M}_\s]', '', 'g')")}) AS words_md5
FROM documents""")
def normalize_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.md5(tx.normalize_text(text)).alias("plain_md5"),
        F.md5(tx.normalize_text(text, remove_punctuation=True)).alias("words_md5"),
    )


@query("normalize_steps", r"""
SELECT doc_id AS id, md5(lower(nfc_normalize(text))) AS default_md5,
       md5(regexp_replace(replace(strip_accents(replace(text, 'ß', chr(1))), chr(1), 'ß'), '[\p{P}$+<=>^`|~]', '', 'g')) AS bare_md5
FROM documents""")
def normalize_steps(spark, sf):
    text = F.col("text")
    bare = tx.apply_steps(text, ["strip_diacritics", "strip_punctuation"])
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.md5(tx.apply_steps(text)).alias("default_md5"), F.md5(bare).alias("bare_md5")
    )


@query("clean_ipa", rf"""
WITH {RECORDS}, c AS (
  SELECT id, regexp_replace(regexp_replace(nfc_normalize(regexp_replace(ipa, '^\s+|\s+$', '', 'g')), '[\[\]/]', '', 'g'), '\s+', ' ', 'g') AS ipa
  FROM records)
SELECT id, ipa, CASE WHEN regexp_matches(coalesce(ipa, ''), '\p{{L}}') THEN 1 ELSE 0 END AS valid FROM c""")
def clean_ipa(spark, sf):
    out = records(spark, sf).select("id", tx.clean_ipa(F.col("ipa")).alias("ipa"))
    return out.withColumn("valid", tx.valid_ipa(F.col("ipa")).cast("int"))


_NAMES_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LANGUAGE_NAMES.items()) + " ELSE x END"


@query("clean_language", rf"""
WITH named AS (
  SELECT doc_id AS id, lower(CASE lang WHEN 'en' THEN ' English' WHEN 'de' THEN 'GERMAN ' ELSE upper(lang) END) AS y FROM documents
), t AS (SELECT id, trim(y) AS x FROM named)
SELECT id, {_NAMES_SQL} AS code, CASE WHEN regexp_matches({_NAMES_SQL}, '^[a-z]{{2,3}}$') THEN 1 ELSE 0 END AS valid FROM t""")
def clean_language(spark, sf):
    lang = F.col("lang")
    raw = F.when(lang == "en", " English").when(lang == "de", "GERMAN ").otherwise(F.upper(lang))
    out = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.clean_language(raw).alias("code"))
    return out.withColumn("valid", tx.valid_language(F.col("code")).cast("int"))


@query("ascii_to_ipa", f"""
WITH {ENTRIES} SELECT id, translate(headword, '{tx.ASCII_PHONES}', '{tx.IPA_PHONES}') AS ipa FROM entries""")
def ascii_to_ipa(spark, sf):
    return entries(spark, sf).select("id", tx.ascii_to_ipa(F.col("headword")).alias("ipa"))


@query("well_formed_ipa", rf"""
WITH {RECORDS} SELECT id, CASE WHEN regexp_matches(coalesce(ipa, ''), '^[\p{{L}}\p{{M}}\p{{Sk}} .‿|‖↗↘ꜛꜜ]+$') THEN 1 ELSE 0 END AS ok FROM records""")
def well_formed_ipa(spark, sf):
    return records(spark, sf).select("id", tx.well_formed_ipa(F.col("ipa")).cast("int").alias("ok"))


_CHAIN_SQL = _squeeze(f"lower(nfc_normalize({_head_sql('headword')}))")


@query("cleaning_chain", f"""
WITH {RECORDS}
SELECT id, {_CHAIN_SQL} AS headword,
  CASE WHEN {_head_sql('headword')} = '' THEN 'Validation failed after headword_cleaner' END AS headword_error,
  'headword_cleaner:1.0.0_text_normalizer:1.0.0' AS signature FROM records""")
def cleaning_chain(spark, sf):
    chain = cleaning.CHAINS["headword"]
    out = chain.apply(records(spark, sf).select("id", "headword"), "headword")
    return out.withColumn("signature", F.lit(chain.signature))


@query("transform_log", f"""
WITH {RECORDS}, log AS (
  SELECT 1 AS step, 'headword_cleaner' AS step_name, {_head_sql('headword')} <> '' AS success FROM records
  UNION ALL SELECT 2, 'text_normalizer', {_CHAIN_SQL} <> '' FROM records)
SELECT step, step_name, success::INT AS success, count(*) AS n FROM log GROUP BY ALL""")
def transform_log(spark, sf):
    log = cleaning.CHAINS["headword"].log(records(spark, sf), "id", "headword")
    return log.groupBy("step", "step_name", F.col("success").cast("int").alias("success")).agg(F.count(F.lit(1)).alias("n"))


@query("entry_ids", f"""
WITH {ENTRIES}, c AS (SELECT *, sha256(to_json({{'definition': definition, 'headword': headword, 'language': language}})::VARCHAR) AS checksum FROM entries)
SELECT id, 'entry_' || substring(sha256(headword || language || definition), 1, 16) AS content_id,
       source_id || '_' || substring(checksum, 1, 16) AS provenance_id, md5(headword || language || definition) AS gloss_id, checksum
FROM c""")
def entry_ids(spark, sf):
    e = entries(spark, sf)
    word, lang, text = F.col("headword"), F.col("language"), F.col("definition")
    e = e.withColumn("checksum", ids.record_checksum(text, word, lang))
    return e.select(
        "id", ids.content_id(word, lang, text).alias("content_id"),
        ids.provenance_id(F.col("source_id"), F.col("checksum")).alias("provenance_id"),
        ids.gloss_id(word, lang, text).alias("gloss_id"), "checksum",
    )


@query("concept_labels", f"""
WITH {ENTRIES}, f AS (SELECT concept_id, arg_min(definition, id) AS d FROM entries WHERE concept_id IS NOT NULL GROUP BY concept_id)
SELECT concept_id, {upper_sql(FIRST_WORDS)} AS label FROM f""")
def concept_labels(spark, sf):
    first = vector_entries(spark, sf).filter("concept_id is not null").groupBy("concept_id").agg(F.min_by("definition", "id").alias("d"))
    return first.select("concept_id", tx.concept_label(F.col("d"), F.col("concept_id")).alias("label"))


@query("json_access", """
SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS top
FROM events WHERE (props->>'$.k') IS NOT NULL GROUP BY event_type""")
def json_access(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return (
        table(spark, sf, "events").filter(k.isNotNull()).groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))
    )


@query("rule_scores_by_language", f"""
WITH {RECORDS}, c AS (SELECT language, len({_errors_sql('strict')}) AS n FROM records)
SELECT language, count(*) AS entries, round(avg(CASE WHEN n = 0 THEN 1e0 ELSE 1e0 - least(0.15e0 * n, 0.9e0) END), 6) AS score
FROM c GROUP BY language""")
def rule_scores_by_language(spark, sf):
    out = _validated(spark, sf, "strict").groupBy("language").agg(
        F.count(F.lit(1)).alias("entries"), F.avg(rules.rule_score(F.size("validation_errors"))).alias("score")
    )
    return out.select("language", "entries", r6("score"))


@query("quality_metrics", f"""
WITH {RECORDS}, c AS (SELECT id, len({_errors_sql('standard')}) AS n, length(definition) AS l FROM records)
SELECT id AS entry_id, 'rule_score' AS metric_name, round(CASE WHEN n = 0 THEN 1e0 ELSE 1e0 - least(0.15e0 * n, 0.9e0) END, 6) AS metric_value FROM c
UNION ALL SELECT id, 'rule_errors', n::DOUBLE FROM c UNION ALL SELECT id, 'definition_length', l::DOUBLE FROM c""")
def quality_metrics(spark, sf):
    return ingest.quality_metrics(records(spark, sf)).withColumn("metric_value", F.round("metric_value", 6))
