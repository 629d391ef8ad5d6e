"""Delimited files with quoted fields that run over lines, read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

STATES = "file_path string, block long, out_to boolean, in_to boolean, out_opened long, in_opened long"
PARTS = "file_path string, block long, record long, edge boolean, text string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line lies in a quoted field; ``inside``: whether its start does.

    A quote opens a field at its very start only, and two quotes are one of the text.
    """
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        close = line.find('"', at)
        if close < 0:
            return True
        if line[close + 1 : close + 2] == '"':
            at, inside = close + 2, True
            continue
        inside, at = False, line.find(",", close + 1) + 1
        if not at:
            return False


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split of a file ends, and how many records it opens, for both states it may begin in."""
    split, now, opened, out = None, [False, True], [0, 0], []
    for batch in batches:
        for line, *key in zip(*(batch[c].to_pylist() for c in ("value", "file_path", "block"))):
            if key != split:
                if split:
                    out.append((*split, *now, *opened))
                split, now, opened = key, [False, True], [0, 0]
            for k in (0, 1):
                if not now[k] and line.strip():
                    opened[k] += 1
                if '"' in line:
                    now[k] = ends_inside(line, now[k])
    if split:
        out.append((*split, *now, *opened))
    if out:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["file_path", "block", "out_to", "in_to", "out_opened", "in_opened"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with their number in the file; those that touch an edge of the split may be parts of one."""
    split, inside, record, lines, head, out = None, False, 0, [], False, []

    def close(edge: bool) -> None:
        if lines:
            out.append((*split, record, edge, "\n".join(lines)))
            lines.clear()

    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("value", "file_path", "block", "inside", "before"))
        for line, file_path, block, start, before in zip(*columns):
            if (file_path, block) != split:
                close(head or inside)
                split, inside, record, head = (file_path, block), start, before, start
            if not inside:
                if not line.strip():
                    continue
                record += 1
            lines.append(line)
            if '"' in line:
                inside = ends_inside(line, inside)
            if not inside:
                close(head)
                head = False
        if out and not lines or len(out) > 10_000:
            yield _table(out)
            out.clear()
    close(head or inside)
    if out:
        yield _table(out)


def _table(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["file_path", "block", "record", "edge", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """Whole records (file_path, record, text) of files that may be split anywhere, numbered from 1 in each file.

    The first pass says, for every split, how a quoted field that is open or not
    at its start leaves it at its end; composed over the splits of a file (one
    row each) this gives the state at every start. The second pass cuts records
    and only those that lie over the edge of a split are put together. Line ends
    inside a record become one line feed.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    splits = lines.mapInArrow(_states, STATES)
    # A split sets the state, flips it or leaves it: the last setting counts, and the flips behind it.
    earlier = Window.partitionBy("file_path").orderBy("block")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum(F.col("out_to").cast("int") * (1 - F.col("in_to").cast("int"))).over(earlier)
    fixed = F.when(F.col("out_to") == F.col("in_to"), F.struct(F.col("out_to").cast("int").alias("state"), "flips"))
    splits = splits.withColumn("flips", flips).withColumn("set", F.last(fixed, ignorenulls=True).over(before))
    passed = F.coalesce(F.lag("flips").over(earlier), F.lit(0)) - F.coalesce("set.flips", F.lit(0))
    splits = splits.withColumn("inside", (F.coalesce("set.state", F.lit(0)) + passed) % 2 == 1)
    opened = F.when(F.col("inside"), F.col("in_opened")).otherwise(F.col("out_opened"))
    splits = splits.select("file_path", "block", "inside", F.coalesce(F.sum(opened).over(before), F.lit(0)).alias("before"))
    # One small row per split of a file; a broadcast keeps the lines in their order.
    parts = lines.join(F.broadcast(splits), ["file_path", "block"]).mapInArrow(_records, PARTS)
    inside = parts.filter("not edge").select("file_path", "record", "text")
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))["text"]
    edges = parts.filter("edge").groupBy("file_path", "record").agg(F.array_join(pieces, "\n").alias("text"))
    return inside.unionByName(edges)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header line in each file, as strings; the first file names the columns."""
    names = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = records(spark, path).filter("record > 1")
    return body.select(F.from_csv("text", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
