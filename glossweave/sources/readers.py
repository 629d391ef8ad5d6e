"""Dictionary files as DataFrames of raw records.

Every reader returns ``headword`` and ``language`` plus the fields its format
has; :func:`as_raw` wraps any of them into rows of the raw table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from glossweave.functions.text import not_blank, strip_blank
from glossweave.session import materialize, settle
from glossweave.sources import quoted


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


_TEXTS = T.ArrayType(T.StringType())

DUMP_LINE = T.StructType([
    _text("word"), _text("lang"), _text("lang_code"), _text("pos"), _text("etymology_text"),
    T.StructField("sounds", T.ArrayType(T.StructType([_text("ipa")]))),
    T.StructField("senses", T.ArrayType(T.StructType([
        T.StructField("glosses", _TEXTS), T.StructField("raw_glosses", _TEXTS),
    ]))),
    _text("_bad"),
])

STORED_LINE = (
    "word string, lang_code string, pos string, etymology_text string, sounds array<struct<ipa:string>>, "
    "senses array<struct<glosses:string, raw_glosses:string>>"
)


def cldf_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of a cross-linguistic data set."""
    rows = quoted.csv(spark, f"{folder}/forms.csv")
    take = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        take("Form").alias("headword"), take("Language_ID").alias("language"), take("Parameter_ID").alias("concept"),
        F.split(take("Segments"), " ").alias("segments"), take("Source").alias("source"), take("Comment").alias("comment"),
    )


def cldf_cognates(spark: SparkSession, folder: str) -> DataFrame:
    """Cognate judgements of a cross-linguistic data set."""
    rows = quoted.csv(spark, f"{folder}/cognates.csv")
    take = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.lit("cognate").alias("type"), take("Form_ID").alias("form_id"), take("Cognateset_ID").alias("cognateset_id"),
        take("Alignment").alias("alignment"), take("Doubt").alias("doubt"),
    )


def cldf(spark: SparkSession, folder: str) -> DataFrame:
    """Forms and cognate judgements in one table."""
    return cldf_forms(spark, folder).unionByName(cldf_cognates(spark, folder), allowMissingColumns=True)


def wide_to_long(wide: DataFrame) -> DataFrame:
    """One row per concept and language of a word list with a column per language."""
    languages = [c for c in wide.columns if c != "concept"]
    long = wide.unpivot("concept", languages, "language", "word")
    word = strip_blank(F.col("word"))
    kept = long.filter(F.col("word").isNotNull() & (F.col("word") != "") & (word != "-"))
    return kept.select(word.alias("headword"), "language", "concept", F.lit("swadesh").alias("source_type"))


def swadesh(spark: SparkSession, path: str) -> DataFrame:
    return wide_to_long(spark.read.csv(path, header=True))


# Markers of the record format and the fields they fill.
MARKERS = {"ph": "ipa", "de": "definition", "et": "etymology", "ps": "pos_tag", "lg": "language"}
FRAGMENT = "file_path string, block long, opened int, line long, headword string, fields map<string, string>"


def starling(spark: SparkSession, path: str) -> DataFrame:
    """Marker files where a line that begins with ``\\lx`` and a blank opens each record, with the number of that line.

    Lines are read without blanks around them. A file may be split anywhere:
    each split gives its records and, apart, the lines before its first one,
    which belong to the last record of an earlier split. Lines and records of
    earlier splits are added up per file, one row per split, and only records
    at the edges of splits are put together. What stands before the first
    record of a file is no record; the last line of a marker wins.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    found = materialize(lines.mapInArrow(_fragments, FRAGMENT), "fragments")
    # A row without fields closes each split: its lines and how many records it opened.
    splits = found.filter("fields IS NULL").select("file_path", "block", F.col("line").alias("_lines"), F.col("opened").alias("_opened"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file_path", "block", F.col("_opened"), F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_lines_before"),
        F.coalesce(F.sum("_opened").over(before), F.lit(0)).alias("_before"),
    )
    parts = found.filter("fields IS NOT NULL").join(F.broadcast(splits), ["file_path", "block"]).select(
        "file_path", "block", (F.col("_before") + F.col("opened")).alias("record"), "headword", "fields",
        F.when(F.col("opened") > 0, F.col("line") + F.col("_lines_before")).alias("line_number"),
        ((F.col("opened") == 0) | (F.col("opened") == F.col("_opened"))).alias("edge"),
    ).filter("record > 0")
    names = list(MARKERS.values())
    field = lambda n: F.col("fields")[n]
    inside = parts.filter("not edge").select("headword", *[field(n).alias(n) for n in names], "file_path", "line_number")
    last = lambda n: F.max(F.when(field(n).isNotNull(), F.struct("block", field(n).alias("v"))))["v"].alias(n)
    joined = parts.filter("edge").groupBy("file_path", "record").agg(
        F.max("headword").alias("headword"), *[last(n) for n in names], F.max("line_number").alias("line_number")
    )
    return inside.unionByName(joined.drop("record"))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split of a file, with what precedes the first one as record 0 and a closing row of totals."""
    split, opened, line, at, headword, fields, out = None, 0, 0, 0, None, {}, []
    markers = {f"\\{m} ": name for m, name in MARKERS.items()}

    def close() -> None:
        if opened or fields:
            out.append((*split, opened, at, headword, fields))

    def table() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
        columns = list(zip(*out))
        columns[5] = [None if f is None else list(f.items()) for f in columns[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in FRAGMENT.split(", ", 5)])

    for batch in batches:
        for value, file_path, block in zip(*(batch[c].to_pylist() for c in ("value", "file_path", "block"))):
            if (file_path, block) != split:
                if split:
                    close()
                    out.append((*split, opened, line, None, None))
                split, opened, line, at, headword, fields = (file_path, block), 0, 0, 0, None, {}
            line += 1
            value = value.strip()
            if value.startswith("\\lx "):
                close()
                opened, at, headword, fields = opened + 1, line, value[4:], {}
            elif value[:4] in markers:
                name = markers[value[:4]]
                fields[name] = value[4:].strip("[]") if name == "ipa" else value[4:]
        if len(out) > 10_000:
            yield table()
            out.clear()
    if split:
        close()
        out.append((*split, opened, line, None, None))
    if out:
        yield table()


def starling_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Marker files where a blank line closes each record."""
    return marker_records(_chunks(spark, path, "\n\n"))


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("value").alias("chunk"), F.col("_metadata.file_path").alias("file_path"))


def marker_records(chunks: DataFrame) -> DataFrame:
    """Fields of one record per row of ``chunk``; the last line of a marker wins."""
    df = chunks.withColumn("_lines", F.split(F.col("chunk"), "\r?\n"))

    def last(marker: str) -> Column:
        hits = F.filter("_lines", lambda x: x.startswith(f"\\{marker} "))
        return F.substring(F.try_element_at(hits, F.lit(-1)), len(marker) + 3, 1 << 30)

    fields = {field: last(marker) for marker, field in MARKERS.items()}
    fields["ipa"] = F.nullif(F.regexp_extract(fields["ipa"], r"^\s*\[(.+)\]$", 1), F.lit(""))
    out = df.select(
        F.regexp_extract(last("lx"), r"^\s*(.+)$", 1).alias("headword"), *[c.alias(n) for n, c in fields.items()],
        *[c for c in chunks.columns if c != "chunk"],
    )
    return out.filter(not_blank(F.col("headword")))


def json_entries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON list of entries, or an object that holds the list as ``entries``.

    Files with one object per line (``multi_line`` off) are read in parts.
    """
    rows = spark.read.json(path, multiLine=multi_line)
    if "entries" in rows.columns:
        rows = rows.select(F.explode("entries").alias("e")).select("e.*")
    return rows


def json_lines(spark: SparkSession, path: str, schema, skip_errors: bool = True) -> DataFrame:
    """One JSON object per line; gzip by file suffix; bad lines are dropped or fatal."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if skip_errors else "FAILFAST")


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary dump lines as read, without the malformed ones."""
    rows = spark.read.schema(DUMP_LINE).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.filter("_bad is null").drop("_bad")


def flatten_all_senses(lines: DataFrame) -> DataFrame:
    """First sound with a transcription; the glosses of all senses, ' | ' between."""
    ipas = F.filter(F.transform("sounds", lambda s: s["ipa"]), lambda x: x.isNotNull())
    senses = F.filter("senses", lambda s: s["glosses"].isNotNull())
    glosses = F.flatten(F.transform(senses, lambda s: s["glosses"]))
    out = lines.select(
        F.col("word").alias("headword"), F.coalesce("lang_code", "lang").alias("language"),
        F.try_element_at(ipas, F.lit(1)).alias("ipa"),
        F.coalesce(F.array_join(glosses, " | "), F.lit("")).alias("definition"),
        F.coalesce("etymology_text", F.lit("")).alias("etymology"),
        F.coalesce("pos", F.lit("")).alias("pos_tag"), F.lit("wiktionary").alias("source_type"),
    )
    return out.filter("headword <> '' and language <> ''")


def flatten_with_raw(lines: DataFrame) -> DataFrame:
    """First sound only; glosses joined by ', ', with raw glosses where there are none."""
    either = lambda s: F.when(F.size(s["glosses"]) > 0, s["glosses"]).otherwise(
        F.coalesce(s["raw_glosses"], F.array().cast("array<string>"))
    )
    return lines.select(
        F.col("word").alias("headword"), F.coalesce("lang_code", "lang").alias("language"),
        F.get("sounds", F.lit(0))["ipa"].alias("ipa"),
        F.coalesce(F.array_join(F.flatten(F.transform("senses", either)), ", "), F.lit("")).alias("definition"),
        F.col("etymology_text").alias("etymology"), F.col("pos").alias("pos_tag"),
    )


def flatten_first_sense(raw: DataFrame, bounded: bool = False) -> DataFrame:
    """First gloss of the first sense, read from the JSON text in ``raw_data``.

    ``bounded`` cuts fields to the widths of the typed table and asks for at
    least one sense.
    """
    text = lambda value: F.coalesce(value, F.lit(""))
    cut = lambda c, n: F.substring(c, 1, n) if bounded else c
    # Each record is parsed once; lists of glosses stay JSON text.
    rest = [c for c in raw.columns if c != "raw_data"]
    parsed = settle(raw.select(*rest, F.from_json("raw_data", STORED_LINE).alias("_r")))
    sense = F.get("_r.senses", F.lit(0))
    gloss = F.get_json_object(sense["glosses"], "$[0]")
    has = lambda name: text(F.col(f"_r.{name}")) != ""
    kept = parsed.filter(has("word") & has("lang_code") & F.col("_r.senses").isNotNull())
    if bounded:
        kept = kept.filter(F.size("_r.senses") > 0)
    return kept.select(
        cut(F.col("_r.word"), 255).alias("headword"), cut(text(F.get("_r.sounds", F.lit(0))["ipa"]), 255).alias("ipa"),
        cut(F.col("_r.lang_code"), 3).alias("language"), F.coalesce(gloss, sense["raw_glosses"], F.lit("")).alias("definition"),
        F.col("_r.etymology_text").alias("etymology"),
        (cut(text(F.col("_r.pos")), 50) if bounded else F.col("_r.pos")).alias("pos_tag"),
        F.md5(F.concat("_r.word", "_r.lang_code", text(gloss if bounded else sense["glosses"]))).alias("id"), *rest,
    )


def wiktionary(spark: SparkSession, path: str) -> DataFrame:
    return flatten_all_senses(dump_lines(spark, path))


def lexicon_xml(spark: SparkSession, path: str, source_id: str = "") -> DataFrame:
    """Entries of an XML lexicon: spelling, all sense definitions, etymology.

    Files are split after each entry, so a lexicon of any size is read in
    parallel; a task parses one entry at a time.
    """
    kind = T.StructType([_text("headword"), _text("definition"), _text("etymology")])

    @F.pandas_udf(kind)
    def parse(chunks: pd.Series) -> pd.DataFrame:
        rows = []
        for chunk in chunks:
            entry = ElementTree.fromstring(chunk + "</entry>")
            orth, etym = entry.find(".//orth"), entry.find(".//etym")
            meanings = [d.text for s in entry.iter("sense") for d in s.iter("def") if d.text]
            rows.append((
                "" if orth is None else orth.text, " | ".join(meanings),
                "" if etym is None else "".join(etym.itertext()),
            ))
        return pd.DataFrame(rows, columns=["headword", "definition", "etymology"])

    chunk = F.regexp_extract("value", r"(?s)<entry[\s>].*", 0)
    rows = spark.read.option("lineSep", "</entry>").text(path).select(chunk.alias("chunk")).filter("chunk <> ''")
    out = rows.select(parse("chunk").alias("e")).select("e.*")
    language = "grc" if "greek" in source_id.lower() else "la"
    return out.filter("headword <> ''").select(
        "headword", F.lit(language).alias("language"), "definition", "etymology", F.lit("perseus").alias("source_type")
    )


def payload_entries(payloads: DataFrame, column: str, schema: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of API answers that hold one object or a list of objects."""
    is_list = F.trim(F.col(column)).startswith("[")
    items = F.when(is_list, F.from_json(column, f"array<{schema}>")).otherwise(F.array(F.from_json(column, schema)))
    rest = [c for c in payloads.columns if c != column]
    rows = payloads.select(*rest, F.explode(items).alias("_item")).select(*rest, "_item.*")
    return transform(rows) if transform else rows


def as_raw(records: DataFrame, source_id: str, file_path: Column | None = None) -> DataFrame:
    """Immutable raw rows: the record as JSON, its checksum and where it came from."""
    names = sorted(c for c in records.columns if c not in ("file_path", "line_number"))
    body = F.to_json(F.struct(*names))
    where = file_path if file_path is not None else (
        F.col("file_path") if "file_path" in records.columns else F.lit(None).cast("string")
    )
    line = F.col("line_number") if "line_number" in records.columns else F.lit(None).cast("long")
    return records.select(
        F.lit(source_id).alias("source_id"), body.alias("raw_data"), F.sha2(body, 256).alias("checksum"),
        where.alias("file_path"), line.alias("line_number"), F.current_timestamp().alias("ingested_at"),
    )


READERS: dict[str, Callable[..., DataFrame]] = {
    "cldf": cldf, "swadesh": swadesh, "csv": swadesh, "starling": starling,
    "json": json_entries, "jsonl": wiktionary, "xml": lexicon_xml,
}


def reader(format: str) -> Callable[..., DataFrame]:
    try:
        return READERS[format.lower()]
    except KeyError:
        raise ValueError(f"Unknown format: {format}") from None
