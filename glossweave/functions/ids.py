"""Identifiers and checksums."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _joined(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_id(headword: Column, language: Column, definition: Column) -> Column:
    digest = F.sha2(_joined(headword, language, definition), 256)
    return F.concat(F.lit("entry_"), F.substring(digest, 1, 16))


def provenance_id(source_id: Column, checksum: Column) -> Column:
    return F.concat_ws("_", F.coalesce(source_id, F.lit("unknown")), F.substring(checksum, 1, 16))


def gloss_id(word: Column, language: Column, gloss: Column) -> Column:
    return F.md5(_joined(word, language, gloss))


def record_checksum(*fields: Column) -> Column:
    """SHA-256 of one canonical text per record: JSON of the given columns.

    Give the columns in name order; fields without a value are left out.
    """
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def pipeline_version(source_name: Column, versions: list[str]) -> Column:
    return F.concat(source_name, F.lit(":"), F.lit("_".join(versions)))
