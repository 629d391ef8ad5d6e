"""Entries out of page text, by line patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from glossweave.functions.text import strip_blank
from glossweave.operators.windows import last_marked


@dataclass(frozen=True)
class LineRule:
    """Pattern that opens an entry, and patterns whose group 1 fills a field."""

    entry: str
    headword: str
    language: str
    definition: str | None = None
    etymology: str | None = None


def split_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per line: (doc, line_no, line), lines numbered from 1."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("_at", "line")
    out = docs.select(F.col(doc).alias("doc"), lines)
    return out.select("doc", (F.col("_at") + 1).alias("line_no"), "line")


def line_entries(lines: DataFrame, rule: LineRule, chunk: int = 10_000) -> DataFrame:
    """Entries of (doc, page, line_no, line) rows; the last match of a field wins.

    An entry is named by the place (page, line_no) of the line that opens it.
    """
    line = strip_blank(F.col("line"))
    marked = lines.withColumn("line", line).withColumn("opens", F.col("line").rlike(f"^(?:{rule.entry})"))
    marked = last_marked(marked, "doc", ("page", "line_no"), "opens", "entry", chunk).filter("entry is not null")
    hit = lambda pattern: F.when(~F.col("opens") & F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.struct("page", "line_no")))
    head = F.when(F.col("line").rlike(rule.headword), F.regexp_extract("line", rule.headword, 1)).otherwise(F.col("line"))
    fields = {"headword": F.max(F.when(F.col("opens"), head))}
    for name in ("definition", "etymology"):
        pattern = getattr(rule, name)
        if pattern:
            fields[name] = last(hit(pattern))
    found = marked.groupBy("doc", "entry").agg(*[c.alias(n) for n, c in fields.items()])
    kept = found.filter("headword is not null and headword <> ''")
    return kept.select(
        "doc", F.col("entry.page").alias("page"), F.col("entry.line_no").alias("line_no"), *fields,
        F.lit(rule.language).alias("language"), F.lit("pdf").alias("source_type"),
    )
