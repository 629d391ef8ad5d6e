"""Duplicates: keep the first, or list them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from glossweave.operators.skew import HEAVY_ROWS, heavy_of, spread_join
from glossweave.session import materialize


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order.

    A rank filter of 1 is applied on the map side as well, so every task sends
    at most one row per key and a key with many copies costs nothing extra.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def duplicate_pairs(df: DataFrame, keys: list[str], index: str, spread_rows: int = HEAVY_ROWS) -> DataFrame:
    """(first, duplicate) for every row that repeats an earlier key.

    The table is read once and leaves a digest and an index per row. The first
    index per key is a partial aggregate; only keys that do repeat are joined
    back, and the copies of a heavy key are spread over tasks.
    """
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    nulls = [F.col(k).isNull() for k in keys]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*same, *nulls)), 256))
    keyed = materialize(df.select(digest.alias("_key"), F.col(index).alias("duplicate")), "digests")
    first = keyed.groupBy("_key").agg(F.min("duplicate").alias("first"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.filter("_n > 1"), "firsts")
    heavy = heavy_of(first, ["_key"], "_n", spread_rows)
    met = spread_join(keyed, first.drop("_n"), ["_key"], heavy=heavy)
    return met.filter(F.col("duplicate") > F.col("first")).select("first", "duplicate")
