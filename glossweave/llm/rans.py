"""Token ids as binary blocks: static range asymmetric numeral system with interleaved lanes.

One frequency table is shared by all blocks. A block holds whole documents and
is coded on its own: lane j takes every n-th id, all lanes share one stream of
32-bit words, and the final lane states are the decoder's start. A block records
its first token, the ids per document and a checksum, so any block can be
decoded and checked alone, in parallel, from any point of the token stream.

Stored form: ``blocks`` (one row per block, ordered by part and block) and
``table`` (frequency of each id, scaled to 2^SCALE) under one folder.

Nulls and empty texts become the end id alone. Rows with a null id come first.
Repeated rows are kept, ties in the id are in any order. An empty table gives
empty folders. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.llm.common import encoder, offsets, slices
from glossweave.session import scratch_path

SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
RAW = "part int, block int, first long, doc_ids array<long>, n_tokens array<int>, ids binary, counted array<int>, counts array<long>"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
BLOCKS = "part int, block int, first long, doc_ids array<long>, n_tokens array<int>, lanes int, states binary, words binary, crc long"


def quantise(ids: np.ndarray, counts: np.ndarray, size: int, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale, at least one for each id that occurs."""
    freq = np.zeros(size, np.int64)
    if not len(ids):
        return freq
    total = 1 << scale
    if len(ids) > total:
        raise ValueError("more distinct ids than slots")
    share = np.maximum(1, np.floor(counts * ((total - len(ids)) / counts.sum())).astype(np.int64))
    # What is left goes to the most frequent ids, or is taken from them.
    order = np.lexsort((ids, -counts))
    left = total - int(share.sum())
    if left >= 0:
        share[order[0]] += left
    for i in order:
        if left >= 0:
            break
        take = min(-left, int(share[i]) - 1)
        share[i] -= take
        left += take
    freq[ids] = share
    return freq


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.scale, self.mask = np.uint64(scale), np.uint64((1 << scale) - 1)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[bytes, bytes]:
        """Lane states and the shared word stream, both little-endian."""
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        shift = np.uint64(63) - self.scale
        for at in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
            s = ids[at : at + lanes]
            y, f = x[: len(s)], self.freq[s]
            full = y >= (f << shift)
            words.append(y[full].astype("<u4"))
            y = np.where(full, y >> WORD, y)
            q = y // f
            x[: len(s)] = (q << self.scale) + (y - q * f) + self.low[s]
        words.reverse()
        return x.astype("<u8").tobytes(), b"".join(w.tobytes() for w in words)

    def decode(self, states: bytes, words: bytes, n: int) -> np.ndarray:
        x, stream = np.frombuffer(states, "<u8").copy(), np.frombuffer(words, "<u4")
        lanes, out, p = len(x), np.empty(n, np.uint32), 0
        for at in range(0, n, lanes):
            y = x[: min(lanes, n - at)]
            slot = y & self.mask
            s = self.slots[slot]
            out[at : at + len(y)] = s
            y = self.freq[s] * (y >> self.scale) + slot - self.low[s]
            thin = np.flatnonzero(y < LOW)
            y[thin] = (y[thin] << WORD) | stream[p : p + len(thin)]
            p += len(thin)
            x[: len(y)] = y
        if p != len(stream) or (x != LOW).any():
            raise ValueError("damaged block: the stream does not end where it should")
        return out


def lanes_for(n: int, most: int = 2048) -> int:
    return max(1, min(most, n // 64))


def raw_blocks(docs: DataFrame, vocabulary: str, end_id: int, block_tokens: int, added: bool = False) -> DataFrame:
    """Ids in ascending order of doc_id, cut into blocks of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, added), TaskContext.get().partitionId()
        end, block, first = np.uint32(end_id).astype("<u4").tobytes(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def full() -> pa.RecordBatch:
            nonlocal ids, names, block, first
            data = b"".join(ids)
            counts = np.bincount(np.frombuffer(data, "<u4"))
            seen = np.flatnonzero(counts)
            counts = counts[seen]
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int32())),
                pa.array([packed(data)], pa.binary()), pa.array([seen.tolist()], pa.list_(pa.int32())),
                pa.array([counts.tolist()], pa.list_(pa.int64())),
            ], ["part", "block", "first", "doc_ids", "n_tokens", "ids", "counted", "counts"])
            block, first, ids, names = block + 1, first + len(data) // 4, [], []
            return row

        held = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                for name, x in zip(piece["doc_id"].to_pylist(), enc.encode(piece["text"])):
                    ids.append(x + end)
                    names.append(name)
                    held += len(x) // 4 + 1
                    if held >= block_tokens:
                        yield full()
                        held = 0
        if ids:
            yield full()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, RAW)


def packed(data: bytes) -> bytes:
    """Ids as they wait to be coded: 16 bits each where they all fit, marked by the first byte."""
    ids = np.frombuffer(data, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 65536 else b"\x04" + data


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, block_tokens: int = 1 << 18, added: bool = False) -> None:
    """Encodes all documents into ``folder``; a block holds about ``block_tokens`` ids, more if one document does."""
    spark = docs.sparkSession
    raw_blocks(docs, vocabulary, end_id, block_tokens, added).write.option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.schema(RAW).parquet(f"{folder}/raw")
    # One row per id of the vocabulary, however many documents there are.
    counted = raw.select(F.inline(F.arrays_zip("counted", "counts"))).groupBy("counted").agg(F.sum("counts").alias("n"))
    rows = counted.toPandas()
    ids, counts = rows["counted"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    freq = quantise(ids, counts, int(ids.max(initial=-1)) + 1)
    table = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(table, "id int, freq int").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = unpacked(row["ids"][0].as_py())
                states, words = coder.encode(ids, lanes := lanes_for(len(ids)))
                yield pa.RecordBatch.from_arrays([
                    *(row[c] for c in ("part", "block", "first", "doc_ids", "n_tokens")), pa.array([lanes], pa.int32()),
                    pa.array([states], pa.binary()), pa.array([words], pa.binary()),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()),
                ], ["part", "block", "first", "doc_ids", "n_tokens", "lanes", "states", "words", "crc"])

    columns = raw.select("part", "block", "first", "doc_ids", "n_tokens", "ids")
    columns.mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")


def read(
    spark: SparkSession, folder: str, view: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = DOCUMENTS
) -> DataFrame:
    """Documents of a folder: doc_id, start, n_tokens, ids (little-endian 32-bit), each block checked on its own.

    ``view`` makes of a batch of such documents what is wanted of them, with its ``schema``, in the task that
    decodes them, so that the ids need not leave it.
    """
    table = spark.read.parquet(f"{folder}/table").toPandas()
    freq = np.zeros(int(table["id"].max()) + 1 if len(table) else 0, np.int64)
    freq[table["id"].to_numpy(np.int64)] = table["freq"].to_numpy()
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # One row per partition of the writing job.
    begins = F.broadcast(offsets(sizes, "part", "n", "before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sizes = np.array(row["n_tokens"], np.int64)
                data = coder.decode(row["states"], row["words"], int(sizes.sum())).astype("<u4").tobytes()
                if zlib.crc32(data) != row["crc"]:
                    raise ValueError(f"damaged block {row['part']}/{row['block']}: checksum differs")
                ends = np.cumsum(sizes)
                cuts = np.append(0, 4 * ends).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                found = pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes + row["first"] + row["before"], pa.int64()),
                    pa.array(sizes), ids,
                ], ["doc_id", "start", "n_tokens", "ids"])
                yield view(found) if view else found

    return blocks.join(begins, "part").drop("crc_").mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, added: bool = False,
    view: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = DOCUMENTS,
) -> DataFrame:
    """Writes the documents and reads them back, as :func:`read` does."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "rans")
    write(docs, folder, vocabulary, end_id, added=added)
    return read(spark, folder, view, schema)
