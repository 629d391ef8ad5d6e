"""Typed tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_text, _real, _whole, _when = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
_texts, _vector = T.ArrayType(_text), T.ArrayType(T.FloatType())

LANGUAGE = _struct(
    ("iso_code", _text), ("name", _text), ("branch", _text), ("subfamily", _text),
    ("coordinates", _struct(("lat", _real), ("lon", _real))),
)

RAW_ENTRY = _struct(
    ("source_id", _text), ("raw_data", _text), ("checksum", _text),
    ("file_path", _text), ("line_number", T.LongType()), ("ingested_at", _when),
)

ENTRY = _struct(
    ("id", _text), ("headword", _text), ("ipa", _text), ("language", _text),
    ("definition", _text), ("etymology", _text), ("pos_tag", _text),
    ("embedding", _vector), ("created_at", _when), ("updated_at", _when),
    ("raw_checksum", _text), ("source_id", _text), ("pipeline_version", _text),
    ("data_quality", _real), ("validation_errors", _texts),
    ("concept_id", _text), ("concept_confidence", _real),
)

DATA_SOURCE = _struct(
    ("id", _text), ("name", _text), ("source_type", _text), ("format", _text),
    ("url", _text), ("license", _text), ("quality", _text), ("version", _text),
    ("retrieved_at", _when), ("metadata", _text),
)

TRANSFORM_LOG = _struct(
    ("record_id", _text), ("step_name", _text), ("step_version", _text),
    ("parameters", T.MapType(_text, _text)), ("executed_at", _when),
    ("duration_ms", _whole), ("success", T.BooleanType()), ("error_message", _text),
)

SIMILARITY_EDGE = _struct(
    ("entry_a", _text), ("entry_b", _text), ("phonetic_score", _real),
    ("semantic_score", _real), ("combined_score", _real), ("confidence", _real),
)

LAYERED_SIMILARITY = _struct(
    ("entry_a", _text), ("entry_b", _text), ("semantic_score", _real),
    ("phonetic_score", _real), ("etymological_score", _real), ("combined_score", _real),
    ("weights", T.MapType(_text, _real)), ("phylogenetic_distance", _whole),
    ("concept_a", _text), ("concept_b", _text),
)

CONCEPT = _struct(
    ("id", _text), ("label", _text), ("centroid", T.ArrayType(_real)), ("size", T.LongType()),
    ("languages", _texts), ("sample_definitions", _texts), ("confidence", _real),
)

COGNATE_SET = _struct(
    ("id", _text), ("size", T.LongType()), ("confidence", _real),
    ("proto_form", _text), ("semantic_core", _text),
)

COGNATE_MEMBER = _struct(("set_id", _text), ("entry_id", _text))

QUALITY_METRIC = _struct(("entry_id", _text), ("metric_name", _text), ("metric_value", _real))

PROGRESS = _struct(
    ("timestamp", _when), ("total", T.LongType()), ("processed", T.LongType()),
    ("succeeded", T.LongType()), ("failed", T.LongType()), ("skipped", T.LongType()),
)
