"""Registration and the shared views of the given tables.

``entries`` reads the document table as a dictionary: the first word of a text
is the headword, its lower-cased form the transcription, the text the
definition, the second line the etymology, and the embedding row with the same
number the vector, whose label is the concept. ``word_forms`` are all words of
all texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.functions.tree import language_rows
from glossweave.operators.dedup import keep_first
from glossweave.session import materialize, share

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where plain SQL can say the same, that SQL."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORD = r"\p{L}+"
POS = (("(tion|ment|ung|ción)$", "noun"), ("(er|en|ir|ar|ing)$", "verb"), ("(ly|able|ible|ful)$", "adj"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return as_entries(share(table(spark, sf, "documents")))


def as_entries(docs: DataFrame) -> DataFrame:
    word = F.regexp_extract("text", WORD, 0)
    pos = F.when(word.rlike(POS[0][0]), POS[0][1])
    for pattern, tag in POS[1:]:
        pos = pos.when(word.rlike(pattern), tag)
    return docs.select(
        F.col("doc_id").alias("id"), word.alias("headword"), F.lower(word).alias("ipa"),
        F.col("lang").alias("language"), F.col("text").alias("definition"),
        F.nullif(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit("")).alias("etymology"),
        pos.alias("pos_tag"), F.col("source").alias("source_id"),
    )


def word_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every whole text, lower-cased, with its language: once per text."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))
    return share(table(spark, sf, "documents")).select(
        F.col("lang").alias("language"), F.explode(F.array_distinct(found)).alias("ipa")
    )


def vector_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with embedding and concept, both null for entries without a vector."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding",
        F.concat(F.lit("concept_"), F.lpad(F.col("label").cast("string"), 4, "0")).alias("concept_id"),
    )
    return entries(spark, sf).join(vectors, "id", "left")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """The typed table: entries with a vector, the first per (headword, language)."""
    kept = vector_entries(spark, sf).filter("embedding is not null")
    return materialize(keep_first(kept, ["headword", "language"], ["id"]), "lexicon")


def concept_table(spark: SparkSession, sf: str) -> DataFrame:
    e = vector_entries(spark, sf).filter("concept_id is not null")
    return e.groupBy(F.col("concept_id").alias("id")).agg(F.count(F.lit(1)).alias("size")).withColumn(
        "label", F.upper("id")
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records: unclean first and second words of each document."""
    return share(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("headword"),
        F.nullif(F.split_part("text", F.lit(" "), F.lit(2)), F.lit("")).alias("ipa"),
        F.col("lang").alias("language"), F.col("text").alias("definition"),
        F.nullif(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit("")).alias("etymology"),
        F.nullif(F.split_part("text", F.lit(" "), F.lit(3)), F.lit("")).alias("pos_tag"),
        F.col("source").alias("source_id"),
    )


_WORD_SQL = rf"regexp_extract(d.text, '{WORD}')"
_POS_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({_WORD_SQL}, '{pattern}') THEN '{tag}'" for pattern, tag in POS
) + " END"

ENTRIES = f"""
entries AS (
  SELECT d.doc_id AS id, {_WORD_SQL} AS headword, lower({_WORD_SQL}) AS ipa, d.lang AS language,
         d.text AS definition, nullif(split_part(d.text, chr(10), 2), '') AS etymology,
         {_POS_SQL} AS pos_tag, d.source AS source_id, v.embedding::DOUBLE[] AS embedding,
         'concept_' || lpad(v.label::VARCHAR, 4, '0') AS concept_id
  FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id
)"""

LEXICON = f"""{ENTRIES},
lexicon AS (
  SELECT * FROM entries WHERE embedding IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY headword, language ORDER BY id) = 1
)"""

RECORDS = """
records AS (
  SELECT doc_id AS id, split_part(text, ' ', 1) AS headword, nullif(split_part(text, ' ', 2), '') AS ipa,
         lang AS language, text AS definition, nullif(split_part(text, chr(10), 2), '') AS etymology,
         nullif(split_part(text, ' ', 3), '') AS pos_tag, source AS source_id
  FROM documents
)"""

# Byte-based edit distance sees one byte per letter once accents have stand-ins.
_ACCENTS = "ßàáâäçèéêëíîïñóôöùúûü"
_STANDINS = "0123456789+-*/=<>!?%&"


def plain(column: str) -> str:
    return f"translate({column}, '{_ACCENTS}', '{_STANDINS}')"


#: First three words of a text d, any Unicode white space between them.
FIRST_WORDS = r"array_to_string(list_slice(string_split(trim(regexp_replace(d, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')), ' '), 1, 3), '_')"

# Letters whose capital is more than one letter, as German sharp s; DuckDB's upper gives each one letter.
_LONG_CAPITALS = {c: c.upper() for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}


def upper_sql(column: str) -> str:
    """Capitals by the full rules of Unicode."""
    keys, values = (", ".join(f"'{x}'" for x in side) for side in (_LONG_CAPITALS, _LONG_CAPITALS.values()))
    long = f"MAP([{keys}], [{values}])"
    letters = f"list_transform(regexp_extract_all({column}, '(?s).'), lambda x: coalesce({long}[x], upper(x)))"
    return f"CASE WHEN regexp_matches({column}, '[{''.join(_LONG_CAPITALS)}]') THEN array_to_string({letters}, '') ELSE upper({column}) END"


def phonetic_sql(a: str, b: str) -> str:
    return f"(1e0 - levenshtein({plain(a)}, {plain(b)}) / greatest(length({a}), length({b}))::DOUBLE)"


#: Similarity from which two words of the whole vocabulary are linked.
WORD_CUT = 0.85

_EDITS = f"floor((1 - {WORD_CUT}) * m + 1e-9)::INT"

# Words within t edits share one of t + 1 pieces of the shorter one, moved by at most t places.
FORMS = f"""word_forms AS MATERIALIZED (
  SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS f FROM documents),
forms AS (SELECT DISTINCT f, length(f) AS len FROM word_forms),
sized AS (SELECT f, len AS n, len + unnest(range(0, 20)) AS m FROM forms),
short AS (
  SELECT f, n, m, i, substr(f, (n * i // (t + 1))::INT + 1, (n * (i + 1) // (t + 1) - n * i // (t + 1))::INT) AS piece
  FROM (SELECT f, n, m, {_EDITS} AS t, unnest(range(0, {_EDITS} + 1)) AS i FROM sized WHERE m - n <= {_EDITS})),
long AS (
  SELECT DISTINCT f, n, m, i, substr(f, p + s + 1, w) AS piece FROM (
    SELECT f, n, m, i, (n * i // (t + 1))::INT AS p, (n * (i + 1) // (t + 1) - n * i // (t + 1))::INT AS w, unnest(range(-t, t + 1))::INT AS s
    FROM (SELECT *, unnest(range(0, t + 1)) AS i FROM (
      SELECT f, len AS m, {_EDITS.replace('* m', '* len')} AS t, len - unnest(range(0, {_EDITS.replace('* m', '* len')} + 1)) AS n FROM forms)))
  WHERE p + s >= 0 AND p + s + w <= m),
met AS (
  SELECT DISTINCT least(a.f, b.f) AS form_a, greatest(a.f, b.f) AS form_b
  FROM short a JOIN long b ON a.n = b.n AND a.m = b.m AND a.i = b.i AND a.piece = b.piece WHERE a.n < a.m OR a.f < b.f),
near AS MATERIALIZED (
  SELECT form_a, form_b, {phonetic_sql('form_a', 'form_b')} AS similarity FROM met WHERE {phonetic_sql('form_a', 'form_b')} >= {WORD_CUT})"""


TREE = "tree AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{code}', {depth}, '{branch}', '{family}', '{'/'.join(path)}')"
    for i, (code, _, depth, branch, family, path) in enumerate(language_rows())
) + ") t(n, code, depth, branch, family, path))"


def distance_sql(a: str, b: str, ta: str, tb: str) -> str:
    """Tree distance of codes a and b with left-joined tree rows ta and tb."""
    return (
        f"CASE WHEN {a} = {b} THEN 0 WHEN {ta}.depth IS NULL OR {tb}.depth IS NULL THEN 999 "
        f"WHEN {ta}.family <> {tb}.family THEN 15 ELSE {ta}.depth + {tb}.depth END"
    )


def chance_sql(d: str) -> str:
    return (
        f"CASE WHEN {d} = 0 THEN 1e0 WHEN {d} = 1 THEN 0.4e0 WHEN {d} = 2 THEN 0.3e0 WHEN {d} <= 4 THEN 0.15e0 "
        f"WHEN {d} <= 6 THEN 0.08e0 WHEN {d} <= 10 THEN 0.03e0 ELSE 0.001e0 END"
    )


def cosine_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)
