"""All pairs of near vectors, exactly, without comparing all vectors with all.

A bounded sample of the vectors are pivots; every vector lives in the cell of
its nearest pivot and visits other cells that may hold a partner. A point of
cell P can have a partner within r in cell Q only if its distance from the
plane half-way between the pivots, (d(x,q)^2 - d(x,p)^2) / 2 d(p,q), is at most
r; all others skip Q. Of two cells the later one visits, so a pair is found
once. A large cell is cut into chunks of bounded size, and tasks compare two
chunks with one matrix product, so no task grows with a cell. Only pairs within
the radius leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from glossweave.functions.vectors import cosine, norm, unit
from glossweave.session import materialize

PIVOTS, CHUNK = 256, 1024
_SLACK = 1e-9


def _pivots(points: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` distinct vectors, the same ones in every run."""
    some = points.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()
    return np.array([r.v for r in some], dtype="float64")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def near_pairs(
    rows: DataFrame, radius: float, block: tuple[str, ...] = (), id: str = "id", vector: str = "vector",
    pivots: int = PIVOTS, chunk: int = CHUNK,
) -> DataFrame:
    """Pairs of rows of one block within a Euclidean distance: (block, a, b, distance), a < b.

    Ids must be unique. Rows without a vector, or with vectors that hold nulls
    or no finite number, have no pairs; vectors must have one length.
    """
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    points = rows.select(*block, F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(sound)
    points = materialize(points, "points")
    pivot = _pivots(points, pivots)
    kind = dict(points.dtypes)["id"]
    out = f"a {kind}, b {kind}, distance double"
    if not len(pivot):
        return points.select(*block, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    apart = np.sqrt(_squares(pivot, pivot))

    @F.pandas_udf("struct<home: int, visits: array<int>>")
    def cells(vectors: pd.Series) -> pd.DataFrame:
        homes, visits = [], []
        # Bounded blocks, so memory does not follow the batch size.
        for start in range(0, len(vectors), 1024):
            d = _squares(np.array(vectors.iloc[start : start + 1024].tolist(), dtype="float64"), pivot)
            home = d.argmin(1)
            own = d[np.arange(len(d)), home][:, None]
            near = d - own <= 2 * apart[home] * (radius + _SLACK) + _SLACK
            near &= np.arange(len(pivot))[None, :] < home[:, None]
            homes += home.tolist()
            visits += [np.flatnonzero(n).tolist() for n in near]
        return pd.DataFrame({"home": pd.Series(homes, dtype="int32"), "visits": visits})

    placed = points.withColumn("_c", cells("v"))
    guest = F.transform("_c.visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("lives")))
    host = F.array(F.struct(F.col("_c.home").alias("cell"), F.lit(True).alias("lives")))
    placed = materialize(placed.select(*block, "id", "v", F.inline(F.concat(host, guest))), "cells")
    sizes = placed.groupBy(*block, "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    own = F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda k: F.struct(F.least("_own", k).alias("i"), F.greatest("_own", k).alias("j")))
    tasks = placed.join(sizes, [*block, "cell"]).withColumn("_own", own).select("*", F.inline(other))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = group[group["_own"] == i], group[group["_own"] == j]
        a, b = (np.array(s["v"].tolist(), dtype="float64") for s in (left, right))
        found = {"a": [], "b": [], "distance": []}
        if len(a) and len(b):
            here, there = left["lives"].to_numpy(), right["lives"].to_numpy()
            ia, ib = left["id"].to_numpy(), right["id"].to_numpy()
            for start in range(0, len(a), 512):
                part = a[start : start + 512]
                close = _squares(part, b) <= radius * radius + _SLACK
                close &= here[start : start + 512, None] | there[None, :]
                x, y = np.nonzero(close)
                x = x + start
                keep = ia[x] < ib[y] if i == j else np.ones(len(x), bool)
                x, y = x[keep], y[keep]
                d = np.sqrt(((a[x] - b[y]) ** 2).sum(1))
                inside = d <= radius + 1e-12
                found["a"].append(ia[x[inside]])
                found["b"].append(ib[y[inside]])
                found["distance"].append(d[inside])
        empty = np.array([], dtype=group["id"].to_numpy().dtype)
        joined = {k: np.concatenate(v) if v else (np.array([]) if k == "distance" else empty) for k, v in found.items()}
        result = pd.DataFrame(joined)
        for name in block:
            result[name] = group[name].iloc[0] if len(result) else pd.Series(dtype=group[name].dtype)
        return result

    names = {n: t for n, t in points.dtypes}
    schema = ", ".join([*(f"`{n}` {names[n]}" for n in block), out])
    pairs = tasks.groupBy(*block, "cell", "i", "j").applyInPandas(
        lambda g: compare(g)[[*block, "a", "b", "distance"]], schema
    )
    return pairs.select(*block, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def similar_vectors(
    rows: DataFrame, min_cosine: float, block: tuple[str, ...] = (), id: str = "id", vector: str = "embedding",
    pivots: int = PIVOTS, chunk: int = CHUNK,
) -> DataFrame:
    """Pairs of rows of one block with cosine >= ``min_cosine``: (block, a, b, semantic), a < b.

    On unit vectors a cosine of s is a distance of sqrt(2 - 2s). Vectors that
    rows share meet once; a zero vector has no cosine and no pairs.
    """
    kept = rows.select(*block, F.col(id).alias("id"), F.col(vector).alias("_e")).filter(F.col("_e").isNotNull() & (norm(F.col("_e")) > 0))
    kept = materialize(kept, "vectors")
    shared = kept.groupBy(*block, "_e").agg(F.min("id").alias("rep"))
    shared = materialize(shared.withColumn("_u", unit(F.col("_e"))), "shared")
    radius = float(np.sqrt(max(2 - 2 * min_cosine, 0.0))) + 1e-7
    near = near_pairs(shared, radius, block, "rep", "_u", pivots, chunk).select(*block, F.col("a").alias("x"), F.col("b").alias("y"))
    near = near.unionByName(shared.select(*block, F.col("rep").alias("x"), F.col("rep").alias("y")))
    named = kept.join(shared.select(*block, "_e", "rep"), [*block, "_e"])
    side = lambda s, e: named.select(*block, F.col("rep").alias(s), F.col("id").alias(f"_{s}"), F.col("_e").alias(e))
    met = near.join(side("x", "_ex"), [*block, "x"]).join(side("y", "_ey"), [*block, "y"])
    met = met.filter((F.col("x") != F.col("y")) | (F.col("_x") < F.col("_y")))
    out = met.select(*block, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), cosine(F.col("_ex"), F.col("_ey")).alias("semantic"))
    return out.filter(F.col("semantic") >= min_cosine)
