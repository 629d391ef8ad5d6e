"""Documents into sequences of fixed length: shortest-pack-first over the length histogram.

A document is cut into full pieces and one remainder. Full pieces are sequences
of their own. Only the histogram of the remainders (at most ``size`` - 1
lengths) comes to the driver: lengths are placed longest first into the packs
with most room, as counts of equal packs. Every place of a pattern then owns a
range of ranks of one length, and remainders find their place by their rank.

Null and empty texts have the end id alone and are packed like any other. Rows
with equal ids are documents of their own. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from glossweave.llm.common import encoder, slices
from glossweave.session import materialize, small_batches

PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long"
PLACES = "length long, lo long, hi long, sequence long, offset long"


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths): shortest-pack-first.

    Packs of equal content are one entry with a count. Lengths come longest
    first; each goes into the pack that is shortest so far, if it fits there,
    else it opens new packs. A pack that is used in part is split by count.
    """
    packs: list[tuple[int, int, int, list[int]]] = []
    done: list[tuple[int, list[int]]] = []
    number = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and packs and packs[0][0] + length <= size:
            used, _, count, lengths = heapq.heappop(packs)
            n = min(left, count)
            left -= n
            if n < count:
                heapq.heappush(packs, (used, number, count - n, lengths))
            for entry in ((used + length, number + 1, n, [*lengths, length]),):
                if entry[0] == size:
                    done.append((n, entry[3]))
                else:
                    heapq.heappush(packs, entry)
            number += 2
        if left:
            heapq.heappush(packs, (length, number, left, [length]))
            number += 1
    return done + [(count, lengths) for _, _, count, lengths in sorted(packs, key=lambda p: p[1])]


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """For each place of each pattern: length, first and last rank, number of the first sequence, offset in it."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            lo = taken.get(length, 0)
            taken[length] = lo + count
            rows.append((length, lo, lo + count, sequence, offset))
            offset += length
        sequence += count
    return rows


def pieces(
    docs: DataFrame, vocabulary: str, end_id: int, size: int, added: bool = False, most: int = 800_000, chars: int = 2_000_000
) -> DataFrame:
    """Pieces of all documents; ``rank`` counts pieces of one length within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, added, most), TaskContext.get().partitionId()
        end = np.uint32(end_id).astype("<u4").tobytes()
        seen, full = np.zeros(size, np.int64), 0
        for batch in batches:
            for piece in slices(batch, "text", chars):
                rows: list[tuple] = []
                for name, x in zip(piece["doc_id"].to_pylist(), enc.encode(piece["text"])):
                    data = memoryview(x + end)
                    total = len(data) // 4
                    for start in range(0, total, size):
                        n = min(size, total - start)
                        rank = full if n == size else int(seen[n])
                        if n == size:
                            full += 1
                        else:
                            seen[n] += 1
                        rows.append((part, name, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), total, rank))
                if rows:
                    kinds = (pa.int32(), *[pa.int64()] * 6)
                    names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, added: bool = False, most: int = 800_000, chars: int = 2_000_000
) -> DataFrame:
    """Every piece with its sequence and its offset there; sequences are numbered without gaps.

    ``most`` (text pieces an encoder remembers) and ``chars`` (bytes of text it
    encodes at once) trade a worker's memory for time; the result is the same.
    """
    spark = docs.sparkSession
    # The encoder needs the memory that large batches of whole texts would take.
    with small_batches(spark):
        cut = materialize(pieces(docs, vocabulary, end_id, size, added, most, chars), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(size, 0)
    rows = [(length, lo, hi, full + sequence, offset) for length, lo, hi, sequence, offset in places(plan(histogram, size))]
    rows += [(size, 0, full, 0, 0)] if full else []
    # Rank of a piece among all pieces of its length: those of earlier partitions come first.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(begins, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # Ranks of one length tile from zero, so (length, rank) sorts like one number.
        firsts = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch[c], np.int64) for c in ("length", "rank"))
            at = np.searchsorted(firsts, length * (1 << 48) + rank, "right") - 1
            place = table[at] if len(at) else table[:0]
            yield pa.RecordBatch.from_arrays([
                *(batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
                pa.array(place[:, 3] + rank - place[:, 1]), pa.array(place[:, 4]),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(run, out)
