"""Order-dependent operators over a whole table, without one big window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from glossweave.session import materialize


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Zero-based position of each row in the global order of ``order``.

    ``order`` must be unique per row, so ties cannot pile up in one range. The
    range-sorted rows are written once; positions are then the place inside the
    range plus the sizes of all earlier ranges.
    """
    place = F.monotonically_increasing_id()
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.pmod(place, F.lit(1 << 33)))
    )
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range: the number of partitions, not of rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    indexed = ranged.join(F.broadcast(offsets), "_range")
    return indexed.withColumn(name, F.col("_place") + F.col("_offset")).drop("_range", "_place", "_offset")


def batches(df: DataFrame, order: list[str], size: int, name: str = "batch_id") -> DataFrame:
    """Fixed-size batches in global order."""
    indexed = with_row_index(df, order)
    return indexed.withColumn(name, F.floor(F.col("row_index") / size)).drop("row_index")


def sliding_windows(
    df: DataFrame, order: list[str], value: str, size: int, block: int = 100_000
) -> DataFrame:
    """Every full window of ``size`` consecutive values: (start, items).

    Rows are cut into blocks; each block also receives the first size - 1 rows
    of the next one, so blocks are windowed independently.
    """
    indexed = with_row_index(df.select(*dict.fromkeys([*order, value])), order)
    home = F.floor(F.col("row_index") / block)
    lead_in = F.pmod(F.col("row_index"), F.lit(block)) < size - 1
    blocks = F.when(lead_in & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    placed = indexed.withColumn("_block", F.explode(blocks))
    ahead = Window.partitionBy("_block").orderBy("row_index").rowsBetween(0, size - 1)
    windows = placed.select(
        "_block", F.col("row_index").alias("start"), F.collect_list(value).over(ahead).alias("items")
    )
    whole = (F.size("items") == size) & (F.floor(F.col("start") / block) == F.col("_block"))
    return windows.filter(whole).drop("_block")


def last_marked(
    df: DataFrame, group: str, order: tuple[str, str], marked: str, name: str, chunk: int = 10_000
) -> DataFrame:
    """Place (both order columns) of the last marked row at or before each row.

    ``order`` is a coarse and a fine position inside the group, both numbers.
    A group is cut into chunks of the fine position. Rows look back inside
    their chunk only; what earlier chunks end with comes from one row per
    chunk, so a group with very many rows is not one task's work.
    """
    coarse, fine = order
    place = F.when(F.col(marked), F.struct(*order))
    cut = df.withColumn("_chunk", F.floor(F.col(fine) / chunk))
    ends = cut.groupBy(group, coarse, "_chunk").agg(F.max(place).alias("_end"))
    before = Window.partitionBy(group).orderBy(coarse, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(ends.select(group, coarse, "_chunk", F.max("_end").over(before).alias("_carried")), "chunks")
    inside = Window.partitionBy(group, coarse, "_chunk").orderBy(fine).rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.withColumn("_seen", F.max(place).over(inside)).join(carried, [group, coarse, "_chunk"])
    return seen.withColumn(name, F.coalesce("_seen", "_carried")).drop("_chunk", "_seen", "_carried")


def first_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per group; map tasks already drop the rest."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)
