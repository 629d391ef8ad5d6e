"""Exact top-k inner products over buckets of vectors of similar length.

Vectors are dealt by length (norm) into buckets, queries into blocks. A bounded
sample gives every query a score it is sure to reach k times. Against a bucket,
that score divided by the two lengths is a threshold for the cosine: above one
the bucket is skipped; when it is high, the coordinates decide (a vector of that
cosine has its largest query coordinates within a narrow range); when it is low,
the length decides (only the longer vectors of the bucket can reach it). What is
left is multiplied out, so results are exact. Partial lists are merged per query.
Blocks and buckets meet in a grid: ``held`` blocks are a row, and a bucket is sent
to each row once, not to each block.

Components are integers. Products are taken in doubles where they are exact and
in Python integers where they might not be.

Defined cases: vectors that are null, empty, or hold a null or a component that
is not finite take no part. Vectors are compared with those of the same number
of components only. Ties go to the smaller id. Rows with a null id take no
part. Rows that repeat an id are vectors of their own, but one query (the
smallest vector); a query meets every vector whose id differs from its own. A zero vector has score 0 with everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from glossweave.session import materialize

EXACT = float(1 << 53)
HIGH = 0.6
FOCUS = 3
BLOCKS = "dim int, part long, rows int, most double, least double, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_column: str, column: str, factor: int) -> DataFrame:
    """(vec_id, v array<long>, dim, norm) of the vectors that take part."""
    v = F.transform(column, lambda x: F.floor(x.cast("double") * factor))
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    out = vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)).filter(F.coalesce(whole, F.lit(False)))
    out = out.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of one dimension, longest first, at most ``most`` to a block, as matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[int], float]] = []
        dim, number = 0, TaskContext.get().partitionId() << 32

        def full() -> pa.RecordBatch:
            nonlocal number
            number += 1
            held.sort(key=lambda h: (-h[2], h[0]))
            ids = np.array([h[0] for h in held], np.int64)
            m = np.array([h[1] for h in held], np.int64)
            norms = [h[2] for h in held]
            return pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()),
                pa.array([max(norms)]), pa.array([min(norms)]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()),
            ], ["dim", "part", "rows", "most", "least", "ids", "vectors"])

        for batch in batches:
            for d, i, v, n in zip(*(batch[c].to_pylist() for c in ("dim", "vec_id", "v", "norm"))):
                if held and (d != dim or len(held) == most):
                    yield full()
                    held = []
                dim = d
                held.append((i, v, n))
        if held:
            yield full()

    # Neighbouring ranges are read by one task each, so that blocks are full; blocks are all that is paired up later.
    tasks = max(1, math.ceil(rows.count() / most))
    dealt = rows.repartitionByRange("dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm"), "vec_id").coalesce(tasks)
    return dealt.select("dim", "vec_id", "v", "norm").mapInArrow(run, BLOCKS)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def best(query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, without itself."""
    keep = ids != query
    ids, scores = ids[keep], scores[keep]
    if len(ids) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= floor
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray], bucket: tuple[np.ndarray, np.ndarray], k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Best rows of one bucket for each query (ids, vectors, scores to reach); the bucket is sorted by length."""
    qids, q, floor = queries
    ids, m = bucket
    length = np.sqrt((m.astype(np.float64) ** 2).sum(1))
    qlen = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    slack = 1 - 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(floor > 0, floor * slack / (qlen * length[0]), -1.0)
    unit = m / np.maximum(length, 1e-300)[:, None]
    by_length: list[int] = []
    columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(len(qids)):
        t = cosine[i]
        if t > 1:
            continue
        if t < HIGH:
            by_length.append(i)
            continue
        # Coordinates: the range that a vector of this cosine can have at the query's largest ones.
        u = q[i] / qlen[i]
        met = np.zeros(len(ids), np.int8)
        focus = np.argsort(-np.abs(u))[:FOCUS]
        for f in focus:
            if f not in columns:
                order = np.argsort(unit[:, f], kind="stable")
                columns[f] = order, unit[order, f]
            order, values = columns[f]
            lo, hi = lower(u[f], t), upper(u[f], t)
            a, b = np.searchsorted(values, lo - 1e-9, "left"), np.searchsorted(values, hi + 1e-9, "right")
            met[order[a:b]] += 1
        rows = np.flatnonzero(met == len(focus))
        if len(rows):
            yield int(qids[i]), *best(int(qids[i]), ids[rows], products(q[i : i + 1], m[rows])[0], k)
    # Length: the bucket is sorted, so the longer vectors are a prefix. Queries of similar prefixes go together.
    need = np.array([0 if floor[i] <= 0 else floor[i] * slack / qlen[i] for i in by_length])
    prefix = np.searchsorted(-length, -need, "right") if len(need) else need
    prefix = np.where(need <= 0, len(ids), prefix)
    for group in np.array_split(np.argsort(prefix, kind="stable"), max(1, len(by_length) // 128)):
        if len(group) and (n := int(prefix[group].max())):
            rows = [by_length[g] for g in group]
            for i, s in zip(rows, products(q[rows], m[:n])):
                yield int(qids[i]), *best(int(qids[i]), ids[:n], s, k)


def lower(u: float, t: float) -> float:
    """Least coordinate of a unit vector whose cosine to the query is t or more."""
    return -1.0 if -u >= t else u * t - math.sqrt((1 - t * t) * max(0.0, 1 - u * u))


def upper(u: float, t: float) -> float:
    return 1.0 if u >= t else u * t + math.sqrt((1 - t * t) * max(0.0, 1 - u * u))


def top_products(
    vectors: DataFrame, k: int = 20, every: int = 20, factor: int = 64, id_column: str = "vec_id", column: str = "embedding",
    bucket: int = 4096, block: int = 1024, sample: int = 2048, held: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose id is divisible by ``every``.

    ``sample`` is the number of longest vectors per dimension that give each
    query its first threshold, ``held`` the number of query blocks a task keeps
    while buckets pass; they change the work, not the result.
    """
    spark = vectors.sparkSession
    rows = materialize(integers(vectors, id_column, column, factor), "vectors")
    buckets = materialize(blocks(rows, bucket), "buckets")
    own = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("x"))
    own = materialize(own.select("vec_id", "x.v", "x.dim", "x.norm"), "queries")
    asked = materialize(blocks(own, block), "asked")
    # One bucket of the longest vectors for each dimension: a fixed number of rows.
    longest = buckets.groupBy("dim").agg(F.max_by("part", F.struct("most", "least", "part")).alias("part"))
    first = buckets.join(longest, ["dim", "part"], "left_semi").select("dim", F.col("ids").alias("sids"), F.col("vectors").alias("svectors"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qids, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, r["dim"])
                sids, s = np.frombuffer(r["sids"], np.int64)[:sample], np.frombuffer(r["svectors"], np.int64).reshape(-1, r["dim"])[:sample]
                floor = np.full(len(qids), -np.inf)
                for i, scores in enumerate(products(q, s)):
                    own = scores[sids != qids[i]]
                    if len(own) >= k:
                        floor[i] = np.partition(own, len(own) - k)[len(own) - k]
                least = float((floor / np.maximum(np.sqrt((q.astype(np.float64) ** 2).sum(1)), 1e-300)).min())
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["dim"]], pa.int32()), pa.array([r["part"]], pa.int64()), pa.array([least]),
                    pa.array([r["ids"]], pa.binary()), pa.array([r["vectors"]], pa.binary()), pa.array([floor.tobytes()], pa.binary()),
                ], ["dim", "qpart", "qleast", "qids", "queries", "floor"])

    known = asked.join(first, "dim").select("dim", "part", "ids", "vectors", "sids", "svectors").mapInArrow(
        floors, "dim int, qpart long, qleast double, qids binary, queries binary, floor binary"
    )
    known = materialize(known, "floors")

    # Numbers of blocks and buckets, without their matrices: one row for each thousand queries or some thousand vectors.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("dim").orderBy("qleast", "qpart")
    numbers = known.select("dim", "qpart", "qleast").withColumn("row", F.floor((F.row_number().over(order) - 1) / held))
    numbers = materialize(numbers, "rows")
    rows_of = numbers.groupBy("dim").agg((F.max("row") + 1).alias("n_rows"))
    shape = buckets.groupBy("dim").agg(F.count(F.lit(1)).alias("n_buckets")).join(rows_of, "dim")
    shape = shape.select("dim", F.least("n_buckets", F.ceil(2 * tasks / F.col("n_rows"))).cast("int").alias("columns"))
    shape = materialize(shape, "shape")
    # The grid: a row of query blocks goes to every column, a bucket to the rows in which a query can use it.
    asked = known.join(numbers.select("dim", "qpart", "row"), ["dim", "qpart"]).join(shape, "dim").select(
        "dim", "row", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), F.lit(0).alias("kind"),
        F.col("qids").alias("ids"), F.col("queries").alias("vectors"), "floor",
    )
    reach = numbers.groupBy("dim", "row").agg(F.min("qleast").alias("qleast"))
    dealt = buckets.join(shape, "dim").join(reach, "dim").filter(F.col("qleast") * (1 - 1e-9) <= F.col("most")).select(
        "dim", "row", F.pmod(F.xxhash64("part"), "columns").cast("int").alias("column"), F.lit(1).alias("kind"),
        "ids", "vectors", F.lit(None).cast("binary").alias("floor"),
    )
    cells = asked.unionByName(dealt).repartition(tasks, "dim", "row", "column").sortWithinPartitions("dim", "row", "column", "kind")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks_here = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                if (at := (r["dim"], r["row"], r["column"])) != cell:
                    cell, blocks_here = at, []
                ids, m = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, r["dim"])
                if r["kind"] == 0:
                    blocks_here.append((ids, m, np.frombuffer(r["floor"])))
                    continue
                for asking in blocks_here:
                    found = list(search(asking, (ids, m), k))
                    if found:
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                            pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found])),
                        ], ["query_id", "vec_id", "score"])

    found = cells.mapInArrow(find, FOUND)
    # Each task keeps its own k best rows of a query before the shuffle.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
