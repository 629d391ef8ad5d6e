"""Density clusters on exact neighbourhoods, in spaces of few dimensions.

A point is core if at least ``min_samples`` points, itself among them, lie
within ``radius``. Core points within the radius of each other are one cluster;
other points join the cluster of their nearest core point within the radius
(ties to the smaller id) or are noise.

The grid has cells whose diagonal is the radius. So the points of one cell are
neighbours, a cell with ``min_samples`` points is core as a whole, and only the
fewer than ``min_samples`` points of other cells are ever counted against the
cells around. Two cells with core points are linked if one pair lies within the
radius: the boxes of their core points rule most pairs of cells out, samples
settle most of the others, and only points within the radius of the other box
are compared for the rest. Work is done in chunks of bounded size, and tasks
give counts, nearest points or links, never pairs of points.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.operators.graph import components
from glossweave.session import materialize

CHUNK, SAMPLE = 2048, 64
_SLACK = 1e-12


def _around(dims: int) -> Column:
    """Steps to all cells that can hold a neighbour."""
    far = int(np.ceil(np.sqrt(dims)))
    steps = [s for s in product(range(-far, far + 1), repeat=dims) if sum(max(abs(x) - 1, 0) ** 2 for x in s) <= dims]
    return F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in steps])


def _cells_around(dims: int) -> Column:
    return F.transform(_around(dims), lambda s: F.zip_with("at", s, lambda x, y: x + y))


def _scan(queries: DataFrame, targets: DataFrame, dims: int, work: Callable, schema: str, chunk: int) -> DataFrame:
    """``work`` on each chunk of a cell's targets together with the queries of the cells around it."""
    sizes = targets.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    placed = targets.join(sizes, "at").select("at", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("part"), "id", "v", F.lit(False).alias("asks"))
    asking = queries.select("id", "v", F.explode(_cells_around(dims)).alias("at")).join(sizes, "at")
    asking = asking.select("at", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), "id", "v", F.lit(True).alias("asks"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        q, t = group[asks], group[~asks]
        if not len(q) or not len(t):
            return work(None, None, None, None)
        return work(q["id"].to_numpy(), np.array(q["v"].tolist()), t["id"].to_numpy(), np.array(t["v"].tolist()))

    return placed.unionByName(asking).groupBy("at", "part").applyInPandas(run, schema)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def density_clusters(
    points: DataFrame, radius: float, min_samples: int = 10, min_size: int = 50, id: str = "id", vector: str = "reduced",
    chunk: int = CHUNK, sample: int = SAMPLE,
) -> DataFrame:
    """(id, cluster, core): members of clusters with at least ``min_size`` points, a cluster named by its smallest core point.

    Ids must be unique; rows without a vector, or with nulls or no finite
    numbers in it, are left out. An empty table gives no rows.
    """
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = points.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(sound)
    first = rows.select(F.size("v").alias("n")).first()
    kind = dict(rows.dtypes)["id"]
    if first is None:
        return rows.select("id", F.col("id").alias("cluster"), F.lit(True).alias("core")).limit(0)
    dims = first.n
    # A little less than the exact side, so that rounding keeps points of a cell within the radius.
    side = radius / np.sqrt(dims) * (1 - 1e-9)
    rows = materialize(rows.withColumn("at", F.transform("v", lambda x: F.floor(x / side).cast("long"))), "points")
    counts = rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.join(counts, "at"), "placed")
    crowded, sparse = rows.filter(F.col("n") >= min_samples), rows.filter(F.col("n") < min_samples)

    def counted(q, a, t, b):
        if q is None:
            return pd.DataFrame({"id": pd.Series(dtype=object), "n": pd.Series(dtype="int64")})
        return pd.DataFrame({"id": q, "n": (_distances(a, b) <= radius + _SLACK).sum(1)})

    near = _scan(sparse, rows, dims, counted, f"id {kind}, n long", chunk).groupBy("id").agg(F.sum("n").alias("near"))
    lonely = materialize(sparse.join(near, "id", "left").select("id", "v", "at", (F.coalesce("near", F.lit(0)) >= min_samples).alias("core")), "sparse")
    core = materialize(crowded.select("id", "v", "at").unionByName(lonely.filter("core").select("id", "v", "at")), "core")

    named = _linked_cells(core, radius, dims, chunk, sample)
    inside = core.select("id", "at").join(named, "at").select("id", "cell", F.lit(True).alias("core"))

    def nearest(q, a, t, b):
        if q is None:
            return pd.DataFrame({"id": pd.Series(dtype=object), "d": pd.Series(dtype="float64"), "by": pd.Series(dtype=object)})
        order = np.argsort(t, kind="stable")
        d = _distances(a, b[order])
        best = d.argmin(1)
        found = pd.DataFrame({"id": q, "d": d[np.arange(len(q)), best], "by": t[order][best]})
        return found[found["d"] <= radius + _SLACK]

    hosts = _scan(lonely.filter("not core"), core, dims, nearest, f"id {kind}, d double, by {kind}", chunk)
    hosts = hosts.groupBy("id").agg(F.min(F.struct("d", "by"))["by"].alias("by"))
    border = hosts.join(inside.select(F.col("id").alias("by"), "cell"), "by").select("id", "cell", F.lit(False).alias("core"))
    members = materialize(inside.unionByName(border), "members")
    big = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("core"), F.col("id"))).alias("cluster"))
    return members.join(big.filter(F.col("n") >= min_size), "cell").select("id", "cluster", "core")


def _linked_cells(core: DataFrame, radius: float, dims: int, chunk: int, sample: int) -> DataFrame:
    """(at, cell): cells with core points, and the smallest cell they are linked with."""
    low = F.array(*[F.min(F.col("v")[i]) for i in range(dims)])
    high = F.array(*[F.max(F.col("v")[i]) for i in range(dims)])
    boxes = materialize(core.groupBy("at").agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("n")), "boxes")
    key = lambda c: F.array_join(c, ",")
    other = boxes.select(F.col("at").alias("to"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("n").alias("n2"))
    met = boxes.select("*", F.explode(_cells_around(dims)).alias("to")).filter(key(F.col("at")) < key(F.col("to"))).join(other, "to")
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(gap("low2", "high"), gap("low", "high2"), lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda s, x: s + x * x)
    met = materialize(met.filter(apart <= (radius + _SLACK) ** 2), "neighbours")

    def links(points: DataFrame) -> DataFrame:
        """Pairs of cells of which a pair of points lies within the radius; ``points`` have the pair, a side and a chunk."""

        def run(group: pd.DataFrame) -> pd.DataFrame:
            left = group["left"].to_numpy()
            a, b = np.array(group["v"][left].tolist()), np.array(group["v"][~left].tolist())
            hit = len(a) and len(b) and any(
                (_distances(a[s : s + 256], b[t : t + 256]) <= radius + _SLACK).any() for s in range(0, len(a), 256) for t in range(0, len(b), 256)
            )
            return group[["at", "to"]].head(1) if hit else group[["at", "to"]].head(0)

        return points.groupBy("at", "to", "i", "j").applyInPandas(run, "at array<bigint>, to array<bigint>").distinct()

    # A bounded number of points per cell settles most pairs; the number does not change the outcome.
    few = _some(core, sample)
    one = lambda at, left: met.select("at", "to").join(few.withColumnRenamed("at", at), at).select("at", "to", "v", F.lit(left).alias("left"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    settled = materialize(links(one("at", True).unionByName(one("to", False))), "settled")
    open_ = materialize(met.join(settled, ["at", "to"], "left_anti"), "open")
    # Of the rest, only points that lie within the radius of the other cell's box.
    reach = lambda lo, hi: F.aggregate(
        F.zip_with(F.zip_with(lo, "v", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("v", hi, lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: F.greatest(x, y)),
        F.lit(0.0), lambda s, x: s + x * x) <= (radius + _SLACK) ** 2
    left = open_.join(core.select("at", "id", "v"), "at").filter(reach("low2", "high2")).select("at", "to", "id", "v", F.lit(True).alias("left"))
    right = open_.join(core.select(F.col("at").alias("to"), "id", "v"), "to").filter(reach("low", "high")).select("at", "to", "id", "v", F.lit(False).alias("left"))
    both = materialize(left.unionByName(right), "close")
    parts = both.groupBy("at", "to").agg(
        F.ceil(F.count_if("left") / chunk).cast("int").alias("ni"), F.ceil(F.count_if(~F.col("left")) / chunk).cast("int").alias("nj")
    ).filter("ni > 0 and nj > 0")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    dealt = both.join(parts, ["at", "to"]).withColumn("_i", F.when(F.col("left"), own("ni")).otherwise(span("ni"))).withColumn(
        "_j", F.when(F.col("left"), span("nj")).otherwise(own("nj"))
    )
    dealt = dealt.select("at", "to", "v", "left", "_j", F.explode("_i").alias("i")).select("at", "to", "v", "left", "i", F.explode("_j").alias("j"))
    found = settled.unionByName(links(dealt))
    named = components(found.select(key(F.col("at")).alias("src"), key(F.col("to")).alias("dst")))
    return boxes.select("at", key(F.col("at")).alias("node")).join(named, "node", "left").select("at", F.coalesce("component", "node").alias("cell"))


def _some(core: DataFrame, most: int) -> DataFrame:
    """At most ``most`` points of each cell: the first of as many hash classes."""
    kinds = core.withColumn("_k", F.pmod(F.xxhash64("id"), F.lit(most)))
    return kinds.groupBy("at", "_k").agg(F.min_by("v", "id").alias("v")).select("at", "v")
