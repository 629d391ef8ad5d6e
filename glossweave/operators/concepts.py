"""Vectors of definitions, and concepts as groups of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from glossweave.functions.text import concept_label
from glossweave.functions.vectors import cosine, dot, unit
from glossweave.operators.density import density_clusters
from glossweave.operators.graph import components
from glossweave.operators.skew import HEAVY_ROWS, MAX_TAXA, heavy_of, require_small_groups, spread_join
from glossweave.operators.windows import first_n, with_row_index
from glossweave.session import fits_in_memory, materialize


def hashed_vectors(df: DataFrame, text: str, dims: int = 256, out: str = "embedding") -> DataFrame:
    """Unit vectors of hashed word counts: the model that needs no download."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims).transform(
        df.withColumn("_words", words)
    )
    scaled = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")


def model_vectors(
    df: DataFrame,
    text: str,
    load_model: Callable[[], Callable[[list[str]], np.ndarray]],
    out: str = "embedding",
) -> DataFrame:
    """Unit vectors by a user's model, loaded once per Python task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_model()
        for texts in batches:
            matrix = np.asarray(encode(texts.fillna("").tolist()), dtype="float32")
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
            yield pd.Series(list(matrix), index=texts.index)

    return df.withColumn(out, run(F.col(text)))


def embed_missing(
    entries: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame] = hashed_vectors,
    spread_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Fill absent vectors; a definition shared by many entries is embedded once."""
    absent = F.col("embedding").isNull() & F.col("definition").isNotNull()
    todo = entries.filter(absent).withColumn("_key", F.sha2("definition", 256))
    texts = todo.groupBy("_key").agg(F.any_value("definition").alias("definition"), F.count(F.lit(1)).alias("_n"))
    vectors = embed(texts, "definition").select("_key", "_n", F.col("embedding").alias("_vector"))
    vectors = materialize(vectors, "vectors")
    heavy = heavy_of(vectors, ["_key"], "_n", spread_rows)
    filled = spread_join(todo.drop("embedding"), vectors.drop("_n"), ["_key"], heavy=heavy)
    filled = filled.withColumnRenamed("_vector", "embedding").select(*entries.columns)
    return entries.filter(~absent).unionByName(filled)


def centroids(entries: DataFrame, group: str = "concept_id") -> DataFrame:
    """Mean vector and size per group; map tasks send one partial sum per group."""
    kept = entries.filter(F.col(group).isNotNull() & F.col("embedding").isNotNull())
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    out = kept.groupBy(group).agg(Summarizer.mean(vector).alias("_mean"), F.count(F.lit(1)).alias("size"))
    return out.select(group, vector_to_array("_mean").alias("centroid"), "size")


def cohesion(entries: DataFrame, centers: DataFrame, group: str = "concept_id") -> DataFrame:
    """Mean cosine between members and their centroid."""
    met = entries.filter(F.col("embedding").isNotNull()).join(centers.select(group, "centroid"), group)
    return met.groupBy(group).agg(F.avg(cosine(F.col("embedding"), F.col("centroid"))).alias("confidence"))


def profile(entries: DataFrame, group: str = "concept_id", samples: int = 5) -> DataFrame:
    """Concept rows: centroid, size, confidence, languages, samples and label.

    Member ids stay in the entry table (one row each), so that no list grows
    with the size of a concept.
    """
    kept = entries.filter(F.col(group).isNotNull())
    centers = materialize(centroids(kept, group), "centers")
    languages = kept.groupBy(group).agg(F.array_sort(F.collect_set("language")).alias("languages"))
    firsts = first_n(kept.select(group, "id", "definition"), [group], ["id"], samples)
    shown = firsts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "definition"))).alias("_s"))
    shown = shown.select(group, F.col("_s.definition").alias("sample_definitions"))
    out = centers.join(cohesion(kept, centers, group), group, "left").join(languages, group).join(shown, group)
    label = concept_label(F.col("sample_definitions")[0], F.col(group).cast("string"))
    return out.withColumn("label", label)


def reduce_dimensions(df: DataFrame, k: int, out: str = "reduced") -> tuple[DataFrame, float]:
    """PCA coordinates of the ``embedding`` column and the variance they explain."""
    vectors = df.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors.select("_v"))
    reduced = model.transform(vectors).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
    return reduced, float(model.explainedVariance.values.sum())


def name_clusters(labelled: DataFrame, min_size: int) -> DataFrame:
    """Drops small clusters and names the rest concept_0000, ... by size."""
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    kept = sizes.filter(F.col("n") >= min_size)
    ranked = with_row_index(kept.withColumn("_loss", -F.col("n")), ["_loss", "first"])
    number = F.lpad(F.col("row_index").cast("string"), 4, "0")
    long = F.length(F.col("row_index").cast("string")) > 4
    number = F.when(long, F.col("row_index").cast("string")).otherwise(number)
    names = ranked.select("cluster", F.concat(F.lit("concept_"), number).alias("concept_id"))
    return labelled.join(names, "cluster").select("id", "concept_id")


def kmeans_concepts(
    entries: DataFrame, k: int, min_size: int = 50, min_cosine: float = 0.0, seed: int = 42
) -> DataFrame:
    """Concepts around ``k`` centres: (id, concept_id); outliers are left out."""
    kept = entries.filter(F.col("embedding").isNotNull()).select("id", unit(F.col("embedding")).alias("_u"))
    points = materialize(kept, "points").withColumn("features", array_to_vector("_u"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", predictionCol="cluster").fit(points)
    placed = model.transform(points).select("id", "cluster", "_u")
    middle = {i: c.tolist() for i, c in enumerate(model.clusterCenters())}
    spark = placed.sparkSession
    centers = spark.createDataFrame(list(middle.items()), "cluster int, center array<double>")
    near = placed.join(F.broadcast(centers), "cluster").filter(cosine(F.col("_u"), F.col("center")) >= min_cosine)
    return name_clusters(near.select("id", "cluster"), min_size)


def density_concepts(
    entries: DataFrame,
    dims: int = 3,
    cell: float | None = None,
    min_samples: int = 10,
    min_size: int = 50,
) -> DataFrame:
    """Concepts as dense regions: (id, concept_id); points in sparse regions are noise.

    Vectors are reduced to ``dims`` coordinates and counted per grid cell. A
    cell is dense when it and its neighbours hold ``min_samples`` points;
    touching dense cells form one concept and adopt the sparse cells beside
    them. Only cells are ever joined, never points with points.
    """
    kept = entries.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    reduced, _ = reduce_dimensions(kept, dims)
    points = materialize(reduced.select("id", "reduced"), "points")
    if cell is None:
        spread = points.agg(F.stddev(F.col("reduced")[0])).first()[0]
        cell = (spread or 1.0) / 2
    place = F.transform("reduced", lambda x: F.floor(x / cell).cast("int"))
    points = points.select("id", place.alias("at"))
    cells = materialize(points.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "cells")

    steps = F.array(*[F.array(*map(F.lit, s)) for s in np.ndindex(*(3,) * dims)])
    around = F.transform(steps, lambda s: F.zip_with("at", s, lambda x, y: x + y - 1))
    reach = cells.withColumn("to", F.explode(around))
    dense = reach.groupBy(F.col("to").alias("at")).agg(F.sum("n").alias("near")).filter(F.col("near") >= min_samples)
    dense = materialize(dense.join(cells, "at", "left_semi").select("at"), "dense")
    touching = dense.select("at", F.explode(around).alias("to")).join(dense.select(F.col("at").alias("to")), "to", "left_semi")
    key = lambda c: F.array_join(c, ",")
    linked = components(touching.select(key(F.col("at")).alias("src"), key(F.col("to")).alias("dst")))
    named = dense.withColumn("node", key(F.col("at"))).join(linked, "node").select("at", "component")
    adopted = (
        named.select(F.explode(around).alias("at"), "component")
        .groupBy("at").agg(F.min("component").alias("adopted"))
    )
    placed = cells.join(named, "at", "left").join(adopted, "at", "left")
    placed = placed.select("at", F.coalesce("component", "adopted").alias("cluster")).filter("cluster is not null")
    return name_clusters(points.join(placed, "at").select("id", "cluster"), min_size)


def neighbour_concepts(entries: DataFrame, radius: float, dims: int = 3, min_samples: int = 10, min_size: int = 50) -> DataFrame:
    """Concepts as density clusters of the reduced vectors, on exact neighbourhoods: (id, concept_id)."""
    kept = entries.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    reduced, _ = reduce_dimensions(kept, dims)
    found = density_clusters(reduced.select("id", "reduced"), radius, min_samples, min_size)
    return name_clusters(found.select("id", "cluster"), min_size)


def assigner(concepts: DataFrame, budget: int = 64 << 20) -> Callable[[DataFrame], DataFrame]:
    """:func:`assign` for many batches: centroids within the budget are read once."""
    first = concepts.select("centroid").first()
    if first is None:
        raise ValueError("no concepts to assign to")
    table = concepts.select("concept_id", "centroid")
    if not fits_in_memory(table, 8 * len(first[0]) + 64, budget):
        return lambda entries: assign(entries, concepts, budget)
    rows = [tuple(r) for r in table.collect()]
    return lambda entries: _best_of(entries.filter(F.col("embedding").isNotNull()), rows, None).drop("_key")


def assign(entries: DataFrame, concepts: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """Nearest concept of every entry with a vector: adds concept_id and confidence.

    Centroids go to the tasks as one matrix when they fit in ``budget`` bytes;
    a longer list is applied piece by piece, each piece within the budget, and
    the best concept so far is kept. Ties go to the smaller concept id.
    """
    kept = entries.filter(F.col("embedding").isNotNull())
    first = concepts.select("centroid").first()
    if first is None:
        raise ValueError("no concepts to assign to")
    per_row = 8 * len(first[0]) + 64
    table = concepts.select("concept_id", "centroid")
    if fits_in_memory(table, per_row, budget):
        return _best_of(kept, [tuple(r) for r in table.collect()], None).drop("_key")
    pieces = -(-table.count() * per_row // (budget // 2))
    numbered = table.withColumn("_piece", F.pmod(F.xxhash64("concept_id"), F.lit(int(pieces))))
    numbered = materialize(numbered, "centroids")
    out = None
    for piece in range(int(pieces)):
        rows = [tuple(r) for r in numbered.filter(F.col("_piece") == piece).drop("_piece").collect()]
        if rows:
            out = materialize(_best_of(kept if out is None else out, rows, out), "assigned")
    return out.drop("_key")


def _best_of(entries: DataFrame, rows: list[tuple], earlier: DataFrame | None) -> DataFrame:
    rows = sorted(rows)
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], dtype="float64")
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
    kind = T.StructType([T.StructField("concept_id", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("_key", T.DoubleType())])

    @F.pandas_udf(kind)
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        block = np.array(vectors.tolist(), dtype="float64")
        if not len(block):
            return pd.DataFrame({"concept_id": pd.Series(dtype=str), **{c: pd.Series(dtype="float64") for c in ("confidence", "_key")}})
        size = np.linalg.norm(block, axis=1, keepdims=True)
        block = np.divide(block, size, out=np.zeros_like(block), where=size > 0)
        close = block @ matrix.T
        # Rounded, so that sums taken in another order cannot turn a tie around.
        rounded = np.round(close, 12)
        best = rounded.argmax(axis=1)
        at = np.arange(len(best)), best
        return pd.DataFrame({"concept_id": [names[i] for i in best], "confidence": close[at], "_key": rounded[at]})

    found = entries.withColumn("_new", nearest(F.col("embedding")))
    if earlier is None:
        return found.drop("concept_id", "confidence").select("*", "_new.*").drop("_new")
    # Pieces are compared by the rounded value as well, so that the budget cannot change the answer.
    better = (F.col("_new._key") > F.col("_key")) | (
        (F.col("_new._key") == F.col("_key")) & (F.col("_new.concept_id") < F.col("concept_id"))
    )
    pick = lambda c: F.when(better, F.col(f"_new.{c}")).otherwise(F.col(c))
    return found.withColumns({"concept_id": pick("concept_id"), "confidence": pick("confidence"), "_key": pick("_key")}).drop("_new")


def language_similarity(entries: DataFrame, taxon: str = "language", group: str | None = None) -> DataFrame:
    """Mean cosine over all pairs of entries of two taxa: (group, a, b, similarity).

    The mean over pairs of unit vectors is the product of the two mean unit
    vectors, so pairs are never formed: one vector sum per taxon is enough.
    """
    keys = [*([group] if group else []), taxon]
    kept = entries.filter(F.col("embedding").isNotNull())
    for key in keys:
        kept = kept.filter(F.col(key).isNotNull())
    means = kept.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(unit(F.col("embedding")))).alias("_m")
    ).withColumn("_m", vector_to_array("_m"))
    label = F.col(group) if group else F.lit("all")
    means = materialize(means.select(label.alias("grp"), F.col(taxon).alias("taxon"), "_m"), "means")
    require_small_groups(means, ["grp"], MAX_TAXA, "taxa")
    side = lambda s: means.select("grp", F.col("taxon").alias(s), F.col("_m").alias(f"_m{s}"))
    met = side("a").join(side("b"), "grp").filter(F.col("a") < F.col("b"))
    return met.select("grp", "a", "b", dot(F.col("_ma"), F.col("_mb")).alias("similarity"))
