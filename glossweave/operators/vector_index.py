"""Vector index in files: exact nearest vectors from few of its partitions.

Vectors are stored in cells, one Parquet partition per cell of nearest pivot,
with their distance from the pivot; a small table says how far each cell
reaches. A search reads the nearest cells until they hold ``k`` rows, which
bounds the distance of the k-th best; of all other cells it reads those that
can hold something nearer by the triangle inequality, and of their rows only
those whose stored distance allows it. Cells and rows that are skipped cannot
change the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.functions.vectors import cosine, norm, unit
from glossweave.operators.nearby import PIVOTS, _pivots, _squares
from glossweave.session import materialize

_SLACK = 1e-9


def build_index(rows: DataFrame, path: str, id: str = "id", vector: str = "embedding", cells: int = PIVOTS) -> None:
    """Writes the index of all rows with a vector of some length; at most ``cells`` partitions."""
    kept = rows.select(F.col(id).alias("id"), F.col(vector).alias("embedding")).filter(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0))
    kept = materialize(kept.withColumn("v", unit(F.col("embedding"))), "vectors")
    pivot = _pivots(kept, cells)

    @F.pandas_udf("struct<cell: int, distance: double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        found = [np.empty((0, 2))]
        for start in range(0, len(vectors), 1024):
            d = _squares(np.array(vectors.iloc[start : start + 1024].tolist(), dtype="float64"), pivot)
            cell = d.argmin(1)
            found.append(np.stack([cell, np.sqrt(d[np.arange(len(d)), cell])], 1))
        both = np.concatenate(found)
        return pd.DataFrame({"cell": both[:, 0].astype("int32"), "distance": both[:, 1]})

    placed = kept.withColumn("_c", nearest("v")).select("id", "embedding", F.col("_c.distance").alias("distance"), F.col("_c.cell").alias("cell"))
    placed = materialize(placed, "placed")
    # A crowded cell is several files; rows are sorted by distance, so that row groups can be skipped as well.
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "distance").write.partitionBy("cell").parquet(f"{path}/vectors")
    reach = placed.groupBy("cell").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("n"))
    middles = kept.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivot)], "cell int, pivot array<double>")
    reach.join(middles, "cell").write.parquet(f"{path}/cells")


def search_index(spark: SparkSession, path: str, target: list[float], k: int = 10, min_similarity: float = -1.0) -> tuple[DataFrame, dict[str, int]]:
    """The ``k`` most similar vectors (id, similarity), ties to the smaller id, and how many cells were read of how many."""
    q = np.array(target, dtype="float64")
    # One row per cell; their number is bounded when the index is built.
    cells = spark.read.parquet(f"{path}/cells").collect()
    if not len(q) or not np.linalg.norm(q) or not cells:
        raise ValueError("the target has no direction, or the index no vectors")
    q = q / np.linalg.norm(q)
    apart = {c.cell: float(np.linalg.norm(q - np.array(c.pivot))) for c in cells}
    rows = spark.read.parquet(f"{path}/vectors")
    similarity = cosine(F.col("embedding"), F.array(*map(F.lit, q.tolist())))

    def best(chosen: list[int], bound: float) -> DataFrame:
        at = F.create_map(*[F.lit(x) for c in chosen for x in (c, apart[c])])[F.col("cell")]
        near = rows.filter(F.col("cell").isin(chosen) & (F.abs(F.col("distance") - at) <= bound))
        scored = near.select("id", similarity.alias("similarity")).filter(F.col("similarity") >= min_similarity)
        return scored.orderBy(F.desc("similarity"), "id").limit(k)

    order, first, held = sorted(cells, key=lambda c: (apart[c.cell], c.cell)), [], 0
    for c in order:
        if held >= k:
            break
        first.append(c.cell)
        held += c.n
    # Nothing below the least similarity is wanted, nor anything farther than the k-th found.
    bound = float(np.sqrt(max(2 - 2 * min_similarity, 0.0))) + _SLACK
    found = best(first, bound).collect()
    if len(found) == k:
        bound = min(bound, float(np.sqrt(max(2 - 2 * found[-1].similarity, 0.0))) + 1e-7)
    needed = [c.cell for c in cells if apart[c.cell] - c.reach <= bound]
    out = best(needed, bound) if needed else best(first, bound)
    return out, {"cells_read": len(set(needed) | set(first)), "cells": len(cells)}
