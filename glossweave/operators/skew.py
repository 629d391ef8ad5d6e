"""Joins on keys of which one may own a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_HEAVY = 1000
HEAVY_ROWS = 100_000
SPREAD = 64

# Languages or sources per group; pairs of them stay in the millions.
MAX_TAXA = 2000


def heavy_keys(rows: DataFrame, keys: list[str], min_rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys with most rows, at most MAX_HEAVY of them.

    The bound costs nothing: a key outside the list owns less than one row in
    MAX_HEAVY, which is an ordinary task.
    """
    return heavy_of(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows", min_rows)


def heavy_of(counted: DataFrame, keys: list[str], count: str, min_rows: int = HEAVY_ROWS) -> DataFrame:
    """The same from rows per key that are known already."""
    top = counted.filter(F.col(count) >= min_rows).orderBy(F.desc(count), *keys).limit(MAX_HEAVY)
    return top.select(*keys)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: int = SPREAD,
    min_rows: int = HEAVY_ROWS,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that cuts the left rows of heavy keys into ``spread`` parts.

    Only the right rows of heavy keys are repeated, once per part. ``how`` may
    be any join that keeps every left row on its own: inner, left, left_semi
    or left_anti. Heavy keys are counted here unless they are given.
    """
    heavy = heavy_keys(left, keys, min_rows) if heavy is None else heavy
    heavy = heavy.withColumn("_heavy", F.lit(True))
    part = F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int")
    every = F.sequence(F.lit(0), F.lit(spread - 1))
    left = (
        left.join(F.broadcast(heavy), keys, "left")
        .withColumn("_part", F.when(F.col("_heavy"), part).otherwise(0))
        .drop("_heavy")
    )
    right = (
        right.join(F.broadcast(heavy), keys, "left")
        .withColumn("_part", F.explode(F.when(F.col("_heavy"), every).otherwise(F.array(F.lit(0)))))
        .drop("_heavy")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")


def require_small_groups(rows: DataFrame, group: list[str], most: int, what: str) -> DataFrame:
    """The rows themselves, after a check that no group has more than ``most`` of them.

    For steps whose result is quadratic in a group that a dimension bounds.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    if not sizes.filter(F.col("_rows") > most).limit(1).isEmpty():
        raise ValueError(f"a group has more than {most} {what}; reduce entries to languages or sources first")
    return rows
