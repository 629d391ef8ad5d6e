"""Benchmark passages in documents, found by spaced seeds that tolerate substitutions.

A window of ``SPAN`` tokens is cut into four blocks. Each of the six masks keeps
two blocks and ignores the others, so any two windows that differ in at most
``TOLERANCE`` = 2 tokens agree under one mask at least: nothing within the
tolerance is missed. Hashes of masked windows of the benchmark are joined with
those of the documents, and the windows behind every hit are compared token by
token. Items of 8 to 15 tokens are one window without tolerance; shorter items
are no evidence and are not searched.

A bit table of fixed size (8 MiB) made from the benchmark's hashes keeps most
windows of clean documents out of the join; the join decides.

Defined cases: null and empty texts match nothing on either side. Rows of one
doc_id, or of one item_id, count together. Rows with a null id are left out of
the pairs, for there is nothing to report them by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import WordNumbers, mix, slices, words
from glossweave.session import materialize

SPAN, BLOCK, TOLERANCE, LEAST = 16, 4, 2, 8
MASKS = list(combinations(range(SPAN // BLOCK), 2))
BITS = 26
WINDOWS = "id long, pos int, seed long, window array<int>"


def run_numbers(numbers: np.ndarray, size: int) -> np.ndarray:
    """Number of the run of ``size`` tokens that starts at each place."""
    n = len(numbers) - size + 1
    out = mix(numbers[:n] + np.uint64(size))
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + n])
    return out


def seeds(numbers: np.ndarray, short: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(window length, seed at each place), mask by mask; ``short`` are lengths that are matched as a whole."""
    if len(numbers) >= SPAN:
        blocks, n = run_numbers(numbers, BLOCK), len(numbers) - SPAN + 1
        for k, (a, b) in enumerate(MASKS):
            first, second = (blocks[BLOCK * x : BLOCK * x + n] for x in (a, b))
            # Blocks are mixed already; odd factors keep them apart at little cost.
            yield SPAN, first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
    for size in short:
        if len(numbers) >= size:
            yield size, mix(run_numbers(numbers, size) + np.uint64(size << 8))


def windows(rows: DataFrame, key: str, short=(), table=None, items: bool = False) -> DataFrame:
    """Masked windows: those of all places, or of the places whose bit is set in ``table``."""
    given = list(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = WordNumbers()
        bits = table.value if table is not None else None
        low = np.uint64((1 << BITS) - 1)
        for batch in batches:
            for piece in slices(batch, "text"):
                out: list[tuple[np.ndarray, ...]] = []
                for name, text in zip(piece[key].to_pylist(), piece["text"].to_pylist()):
                    numbers = number.of(words(text))
                    short = ([len(numbers)] if LEAST <= len(numbers) < SPAN else []) if items else given
                    for size, seed in seeds(numbers, short):
                        if bits is None:
                            at = np.arange(len(seed))
                        else:
                            bit = seed & low
                            at = np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                        if len(at):
                            tokens = numbers.astype(np.uint32).view(np.int32)
                            shown = tokens[at[:, None] + np.arange(size)[None, :]]
                            out.append((np.full(len(at), name, np.int64), at.astype(np.int32), seed[at].view(np.int64), shown))
                for ids, at, seed, shown in out:
                    lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * shown.shape[1], pa.array(shown.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), pa.array(seed), lists], ["id", "pos", "seed", "window"])

    named = rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return named.filter(F.col(key).isNotNull()).mapInArrow(run, WINDOWS)


def bit_table(spark, seeds: DataFrame):
    """Bits of the seeds, 2^BITS of them however many seeds there are."""
    place = F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in parts.collect():
        start = (row["part"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_places (distinct places of the document), first_token, end_token, mismatches (fewest)."""
    spark = docs.sparkSession
    known = materialize(windows(benchmark, "item_id", items=True), "items")
    # At most SPAN - LEAST lengths.
    short = [r["n"] for r in known.select(F.size("window").alias("n")).filter(F.col("n") < SPAN).distinct().collect()]
    hits = windows(docs, "doc_id", short, bit_table(spark, known))
    known = known.select(F.col("id").alias("item_id"), "seed", F.col("window").alias("wanted"))
    met = hits.join(known, "seed").filter(F.size("window") == F.size("wanted"))
    apart = F.aggregate(F.zip_with("window", "wanted", lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    size = F.size("window")
    met = met.select("item_id", F.col("id").alias("doc_id"), "pos", size.alias("size"), apart.alias("apart"))
    met = met.filter(F.col("apart") <= F.when(F.col("size") < SPAN, 0).otherwise(TOLERANCE))
    # One row per place first: a place is found under several masks.
    places = met.groupBy("doc_id", "item_id", "pos").agg(F.min("apart").alias("apart"), F.max("size").alias("size"))
    return places.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_places"), F.min("pos").alias("first_token"),
        F.max(F.col("pos") + F.col("size")).alias("end_token"), F.min("apart").alias("mismatches"),
    )
