"""Coordinates for plots: concepts, language space and similarity networks."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.operators.concepts import reduce_dimensions


def _axes(column: str, dims: int) -> list[Column]:
    return [F.col(column)[i].alias(axis) for i, axis in enumerate("xyz"[:dims])]


def concept_map(concepts: DataFrame, members: DataFrame, dims: int = 2, top: int = 100) -> tuple[DataFrame, float]:
    """The ``top`` largest concepts and all their members under one projection.

    Rows: kind (centroid or member), label or concept id, and coordinates.
    """
    shown = concepts.orderBy(F.desc("size"), "concept_id").limit(top)
    centers = shown.select(
        F.lit("centroid").alias("kind"), F.col("concept_id").alias("concept"), "label",
        array_to_vector(F.col("centroid").cast("array<double>")).alias("_v"),
    )
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(centers.select("_v"))
    kept = members.filter(F.col("embedding").isNotNull()).join(shown.select("concept_id"), "concept_id", "left_semi")
    points = kept.select(
        F.lit("member").alias("kind"), F.col("concept_id").alias("concept"), F.lit(None).cast("string").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"),
    )
    placed = model.transform(centers.unionByName(points)).withColumn("p", vector_to_array("_p"))
    return placed.select("kind", "concept", "label", *_axes("p", dims)), float(model.explainedVariance.values.sum())


def language_space(entries: DataFrame, dims: int = 3) -> tuple[DataFrame, float]:
    """A point per entry with a vector, with its language and headword."""
    kept = entries.filter(F.col("embedding").isNotNull())
    placed, explained = reduce_dimensions(kept.select("id", "language", "headword", "embedding"), dims)
    return placed.select("id", "language", "headword", *_axes("reduced", dims)), explained


def similarity_network(
    entries: DataFrame, edges: DataFrame, threshold: float = 0.7, dims: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Nodes with coordinates and the edges at or above the threshold."""
    nodes, _ = language_space(entries, dims)
    links = edges.filter(F.col("weight") >= threshold)
    return nodes.withColumnRenamed("headword", "label"), links.select(
        F.col("src").alias("source"), F.col("dst").alias("target"), "weight"
    )
