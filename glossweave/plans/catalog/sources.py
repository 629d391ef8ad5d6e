"""Readers over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from glossweave.functions import phonetic
from glossweave.plans.catalog.base import ENTRIES, LEXICON, entries, lexicon, query, table
from glossweave.session import scratch_path
from glossweave.sources import catalog, html, lines, readers, sinks


def _dump(spark, sf):
    """Documents as dictionary-dump lines: one sense per line of text.

    A line that ends with a full stop is a gloss, any other only a raw gloss.
    """
    e = entries(spark, sf)
    line = F.split("definition", "\n")
    sense = lambda x: F.struct(
        F.when(x.endswith("."), F.array(x)).alias("glosses"), F.array(x).alias("raw_glosses")
    )
    return e.select(
        F.col("headword").alias("word"), F.col("language").alias("lang_code"), F.upper("language").alias("lang"),
        F.col("pos_tag").alias("pos"), F.col("etymology").alias("etymology_text"),
        F.array(F.struct(F.lit(None).cast("string").alias("ipa")), F.struct(F.col("ipa"))).alias("sounds"),
        F.transform(line, sense).alias("senses"), F.col("id").alias("doc"),
    )


def _dump_file(spark, sf):
    path = scratch_path(spark, "dump")
    _dump(spark, sf).drop("doc").write.option("compression", "gzip").json(path)
    return path


_SENSES = f"""{ENTRIES}, s AS (SELECT *, string_split(definition, chr(10)) AS parts FROM entries)"""


@query("dump_all_senses", f"""
WITH {_SENSES} SELECT headword, language, ipa, md5(array_to_string(list_filter(parts, lambda x: x LIKE '%.'), ' | ')) AS definition_md5,
  coalesce(pos_tag, '') AS pos_tag FROM s""")
def dump_all_senses(spark, sf):
    out = readers.wiktionary(spark, _dump_file(spark, sf))
    return out.select("headword", "language", "ipa", F.md5("definition").alias("definition_md5"), "pos_tag")


@query("dump_with_raw", f"""
WITH {_SENSES} SELECT headword, language, md5(array_to_string(parts, ', ')) AS definition_md5, pos_tag FROM s""")
def dump_with_raw(spark, sf):
    out = readers.flatten_with_raw(readers.dump_lines(spark, _dump_file(spark, sf)))
    return out.select("headword", "language", F.md5("definition").alias("definition_md5"), "pos_tag")


_FIRST = """CASE WHEN parts[1] LIKE '%.' THEN parts[1] ELSE to_json([parts[1]])::VARCHAR END"""


@query("raw_to_entries", f"""
WITH {_SENSES}, known AS (SELECT DISTINCT lang AS code FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
k AS (SELECT md5(headword || language || CASE WHEN parts[1] LIKE '%.' THEN parts[1] ELSE '' END) AS id, headword, language, md5({_FIRST}) AS definition_md5, id AS doc
      FROM s WHERE language IN (FROM known))
SELECT id, headword, language, definition_md5 FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc) = 1""")
def raw_to_entries(spark, sf):
    """Typed entries out of stored JSON: known languages only, first row per id."""
    dump = _dump(spark, sf)
    raw = dump.select(F.col("doc"), F.to_json(F.struct(*[c for c in dump.columns if c != "doc"])).alias("raw_data"))
    flat = readers.flatten_first_sense(raw, bounded=True)
    known = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi")
    fit = flat.join(known.select(F.col("lang").alias("language")).distinct(), "language", "left_semi")
    out = sinks.append_new(fit.limit(0).select("id"), fit, ["id"], ["doc"])
    return out.select("id", "headword", "language", F.md5("definition").alias("definition_md5"))


@query("raw_rows", """
SELECT sha256(to_json({'lang': lang, 'text': text})::VARCHAR) AS checksum, count(*) AS n FROM documents GROUP BY checksum""")
def raw_rows(spark, sf):
    raw = readers.as_raw(table(spark, sf, "documents").select("text", "lang"), "documents")
    return raw.groupBy("checksum").agg(F.count(F.lit(1)).alias("n"))


def _marker_text():
    flat = lambda c: F.translate(c, "\n", " ")
    return F.concat(
        F.lit("\\lx "), "headword", F.lit("\n\\ph ["), "ipa", F.lit("]\n\\de "), flat(F.col("definition")),
        F.when(F.col("pos_tag").isNotNull(), F.concat(F.lit("\n\\ps "), F.col("pos_tag"))).otherwise(""),
        F.lit("\n\\lg "), "language", F.lit("\n"),
    )


def _marker_file(spark, sf):
    path = scratch_path(spark, "markers")
    entries(spark, sf).select(_marker_text().alias("value")).write.text(path)
    return path


_MARKERS = f"""
WITH {ENTRIES} SELECT headword, ipa, md5(trim(replace(definition, chr(10), ' '))) AS definition_md5, pos_tag, language FROM entries"""


@query("marker_records", _MARKERS)
def marker_records(spark, sf):
    out = readers.starling(spark, _marker_file(spark, sf))
    return out.select("headword", "ipa", F.md5(F.trim("definition")).alias("definition_md5"), "pos_tag", "language")


@query("marker_lines", f"""
WITH {ENTRIES}, placed AS (
  SELECT *, id // 500 AS bucket, row_number() OVER b AS n,
         coalesce(sum(4 + (pos_tag IS NOT NULL)::INT) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM entries WINDOW b AS (PARTITION BY id // 500 ORDER BY id))
SELECT bucket, (3 + before)::BIGINT AS line_number, headword FROM placed""")
def marker_lines(spark, sf):
    """Files of 500 records behind a preamble of two lines, read back with the first line of each record."""
    record = F.regexp_replace(_marker_text(), r"\n$", "")
    bucket = F.floor(F.col("id") / 500)
    placed = entries(spark, sf).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "id")
    lead = F.when(F.col("id") == F.min("id").over(Window.partitionBy("bucket")), F.lit("\\_sh v3.0 400\n\\de of no record\n")).otherwise("")
    path = scratch_path(spark, "marker-lines")
    out = placed.select("bucket", "id", F.concat(lead, record).alias("value"))
    out.sortWithinPartitions("bucket", "id").select("bucket", "value").write.partitionBy("bucket").text(path)
    read = readers.starling(spark, path)
    return read.select(F.regexp_extract("file_path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "line_number", "headword")


@query("marker_blocks", _MARKERS)
def marker_blocks(spark, sf):
    out = readers.starling_blocks(spark, _marker_file(spark, sf))
    return out.select("headword", "ipa", F.md5(F.trim("definition")).alias("definition_md5"), "pos_tag", "language")


@query("word_list", f"""
WITH {LEXICON} SELECT concept_id AS concept, language, arg_min(headword, id) AS headword FROM lexicon GROUP BY ALL""")
def word_list(spark, sf):
    """A wide word list, a column per language, read back as rows."""
    first = lexicon(spark, sf).groupBy("concept_id", "language").agg(F.min_by("headword", "id").alias("headword"))
    wide = first.withColumnRenamed("concept_id", "concept").groupBy("concept").pivot("language").agg(F.first("headword"))
    path = scratch_path(spark, "swadesh")
    wide.fillna("-").write.csv(path, header=True)
    return readers.swadesh(spark, path).select("concept", "language", "headword")


@query("cross_linguistic_set", f"""
WITH {LEXICON} SELECT 'form' AS kind, headword AS a, language AS b, concept_id AS c FROM lexicon
UNION ALL SELECT 'cognate', id::VARCHAR, concept_id, NULL FROM lexicon""")
def cross_linguistic_set(spark, sf):
    words = lexicon(spark, sf)
    path = scratch_path(spark, "cldf")
    words.select(
        F.col("id").alias("ID"), F.col("headword").alias("Form"), F.col("language").alias("Language_ID"),
        F.col("concept_id").alias("Parameter_ID"), F.array_join(phonetic.graphemes(F.col("ipa")), " ").alias("Segments"),
        F.col("source_id").alias("Source"),
    ).write.csv(f"{path}/forms.csv", header=True, escape='"')
    words.select(F.col("id").alias("Form_ID"), F.col("concept_id").alias("Cognateset_ID")).write.csv(f"{path}/cognates.csv", header=True)
    out = readers.cldf(spark, path)
    is_form = F.col("type").isNull()
    return out.select(
        F.when(is_form, "form").otherwise(F.col("type")).alias("kind"),
        F.when(is_form, F.col("headword")).otherwise(F.col("form_id")).alias("a"),
        F.when(is_form, F.col("language")).otherwise(F.col("cognateset_id")).alias("b"), F.col("concept").alias("c"),
    )


@query("json_dictionary", """
SELECT md5(unnest(string_split(text, chr(10)))) AS definition_md5, lang AS language FROM documents""")
def json_dictionary(spark, sf):
    """Objects that hold their entries in a list, one object per document."""
    docs = table(spark, sf, "documents")
    item = lambda x: F.struct(x.alias("definition"), F.col("lang").alias("language"))
    path = scratch_path(spark, "json")
    docs.select(F.transform(F.split("text", "\n"), item).alias("entries")).write.json(path)
    out = readers.json_entries(spark, path, multi_line=False)
    return out.select(F.md5("definition").alias("definition_md5"), "language")


@query("json_lines", "SELECT event_id, user_id, event_type FROM events")
def json_lines(spark, sf):
    """Event lines with one broken line per file among them."""
    path = scratch_path(spark, "lines")
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    good = ev.select(F.to_json(F.struct(*ev.columns)).alias("value"))
    bad = ev.filter("event_type = 'error'").select(F.concat(F.lit('{"event_id": '), F.col("event_type")).alias("value"))
    good.unionByName(bad).write.option("compression", "gzip").text(path)
    return readers.json_lines(spark, path, ev.schema)


@query("lexicon_xml", f"""
WITH {ENTRIES} SELECT headword, 'la' AS language, md5(array_to_string(string_split(definition, chr(10)), ' | ')) AS definition_md5,
  md5(coalesce(etymology, '') || '(' || source_id || ')') AS etymology_md5 FROM entries""")
def lexicon_xml(spark, sf):
    e = entries(spark, sf)
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    senses = F.array_join(F.transform(F.split(safe(F.col("definition")), "\n"), lambda x: F.concat(F.lit("<sense><def>"), x, F.lit("</def></sense>"))), "")
    entry = F.concat(
        F.lit("<entry><form><orth>"), safe(F.col("headword")), F.lit("</orth></form>"), senses, F.lit("<etym>"),
        safe(F.coalesce("etymology", F.lit(""))), F.lit("(<ref>"), "source_id", F.lit("</ref>)</etym></entry>"),
    )
    path = scratch_path(spark, "xml")
    e.select(entry.alias("value")).write.text(path)
    out = readers.reader("xml")(spark, path, "lexicon")
    return out.select("headword", "language", F.md5("definition").alias("definition_md5"), F.md5("etymology").alias("etymology_md5"))


@query("payload_entries", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def payload_entries(spark, sf):
    """Answers that are one object, or for clicks a list with that object."""
    listed = F.when(F.col("event_type") == "click", F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    payloads = table(spark, sf, "events").select("event_id", listed.alias("body"))
    return readers.payload_entries(payloads, "body", "struct<k:bigint>")


# A reference may stand without its semicolon, as HTML has it; a text that is cut off ends so.
_PLAIN = "regexp_replace(regexp_replace(trim(regexp_replace({}, '<[^>]*>', '', 'g')), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query("html_entries", f"""
WITH a AS (SELECT url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages)
SELECT {_PLAIN.format("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)")} AS headword, url AS source_url, 'en' AS language,
  md5({_PLAIN.format("regexp_extract(body, '(?s)<p>(?:<b>)?(.*?)(?:<br>)?(?:</p>|<p>|$)', 1)")}) AS definition_md5 FROM a""")
def html_entries(spark, sf):
    rules = html.Selectors(entry="article", headword="h1", definition="p", language="en")
    out = html.extract_entries(table(spark, sf, "pages"), rules)
    return out.select("headword", "source_url", "language", F.md5("definition").alias("definition_md5"))


_LINE_RULE = lines.LineRule(
    entry=r"\p{Lu}\p{Ll}{0,2} ", headword=r"^(\p{L}+)", language="en", definition=r"(\p{L}+)\.$", etymology=r"^(\p{L}+) "
)


@query("line_entries", r"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT *, regexp_matches(line, '^\p{Lu}\p{Ll}{0,2} ') AS opens FROM l),
r AS (SELECT *, max(CASE WHEN opens THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS entry FROM m)
SELECT doc_id AS doc, entry::BIGINT AS line_no, max(regexp_extract(line, '^(\p{L}+)', 1)) FILTER (opens) AS headword,
  arg_max(regexp_extract(line, '(\p{L}+)\.$', 1), n) FILTER (NOT opens AND regexp_matches(line, '(\p{L}+)\.$')) AS definition,
  arg_max(regexp_extract(line, '^(\p{L}+) ', 1), n) FILTER (NOT opens AND regexp_matches(line, '^(\p{L}+) ')) AS etymology
FROM r WHERE entry IS NOT NULL GROUP BY doc_id, entry""")
def line_entries(spark, sf):
    rows = lines.split_lines(table(spark, sf, "documents"), "doc_id", "text").withColumn("page", F.lit(1))
    return lines.line_entries(rows, _LINE_RULE, chunk=8).select("doc", "line_no", "headword", "definition", "etymology")


@query("source_catalog", """
WITH s AS (SELECT source AS id, min(length(source)) - 3 AS priority, count(*) AS n FROM documents GROUP BY source)
SELECT priority, count(*) AS sources, sum(n)::BIGINT AS entries_approx FROM s WHERE priority <= 1 GROUP BY priority""")
def source_catalog(spark, sf):
    """A catalogue file made of the sources in use, then selected and summed."""
    per = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")
    text = "\n".join(
        f'[[source]]\nid = "{r.source}"\nname = "{r.source}"\npriority = {len(r.source) - 3}\nentries_approx = {r.n}' for r in per.collect()
    )
    return catalog.by_priority(catalog.select_sources(catalog.load_catalog(spark, text), max_priority=1))
