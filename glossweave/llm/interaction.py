"""What filters remove together, alone and in every order: steps of all orders and exact Shapley values.

A document is known by the filters it fails, so with k filters a part of the
corpus is a table of 2^k counts. ``removed(S)``, the documents that at least
one filter of the coalition S fails, is tabulated for all coalitions. A step of
an order removes the difference of two coalitions, whatever the order before.

The Shapley values solve least squares: over all proper coalitions S with the
kernel weight (k - 1) / (C(k, |S|) |S| (k - |S|)), the sum of the values of S
comes as near to removed(S) as it can, while the values of all filters add up
to removed(all). The matrix of the normal equations is the same for every part;
it is inverted once in rationals, and every part brings its own right-hand
side in whole numbers, so the results are exact.

Defined cases: a null text is an empty one. Filter E compares whole texts (by
SHA-256) over the whole table; a row with a null id has no smaller id beside
it and is smaller than none, so it neither fails E nor lets others fail; rows
that repeat an id do not let each other fail. A null part is the empty string.
Labels are one per id: 1 if any row of the id says so; ids without one are
neither good nor toxic. Very long texts stay within one row's arrays of words.
An empty table has no part and gives no rows. Only the columns named are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.session import materialize

FILTERS = "ABCDE"
#: White space that parts words.
GAPS = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> Column:
    """Bits of the filters A to D of one text: short, repetitive, capitals, signs."""
    text = F.coalesce(text, F.lit(""))
    found = F.array_remove(F.split(text, GAPS, -1), "")
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        n < 200,
        F.lit(100).cast("long") * distinct < F.lit(50).cast("long") * n,
        F.lit(100).cast("long") * capitals > F.lit(3).cast("long") * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).alias("mask")


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit 0 being A.

    Texts leave the scan as 32 bytes. Copies are counted before they meet: per
    text, part and label only the smallest id and the rows of it go on, so a
    text that a third of all rows repeat is a few rows.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_flags(F.col("text")),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = rows.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = materialize(ids.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first.alias("first")
    ), "copies")
    smallest = copies.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    copies = copies.join(smallest, "digest")
    passing = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    kept = copies.withColumn("passing", passing)
    both = kept.select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )))
    return both.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def inverse(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Inverse of a matrix of rationals, by elimination."""
    n = len(rows)
    work = [[*r, *(Fraction(i == j) for j in range(n))] for i, r in enumerate(rows)]
    for c in range(n):
        at = next(r for r in range(c, n) if work[r][c])
        work[c], work[at] = work[at], work[c]
        work[c] = [x / work[c][c] for x in work[c]]
        for r in range(n):
            if r != c and work[r][c]:
                work[r] = [x - work[r][c] * y for x, y in zip(work[r], work[c])]
    return [r[n:] for r in work]


def whole(rows: list[list[Fraction]]) -> tuple[list[list[int]], int]:
    """The same rationals as whole numbers over one divisor."""
    divisor = lcm(*(x.denominator for row in rows for x in row))
    return [[int(x * divisor) for x in row] for row in rows], divisor


def kernel(k: int) -> list[int]:
    """Weight of a coalition by its size, as whole numbers; none for the empty one and for all filters, which are constraints."""
    weights = [Fraction(k - 1, comb(k, s) * s * (k - s)) for s in range(1, k)]
    return [0, *whole([weights])[0][0], 0]


def solver(k: int) -> tuple[list[list[int]], int]:
    """Value of each filter as a combination of the right-hand sides and of what all filters remove.

    The normal equations with a multiplier for the constraint, inverted; the
    row of the multiplier is not needed. Whole numbers over one divisor.
    """
    weights = kernel(k)
    gram = [
        [Fraction(sum(weights[s.bit_count()] for s in range(1 << k) if s >> i & 1 and s >> j & 1)) for j in range(k)] for i in range(k)
    ]
    bordered = [*([*row, Fraction(1)] for row in gram), [*([Fraction(1)] * k), Fraction(0)]]
    return whole(inverse(bordered)[:k])


def steps(filters: str) -> list[dict]:
    """Every step of every order, with the coalitions before and after it."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            name = "".join(filters[j] for j in order)
            out.append({"filter_order": name, "step": step, "i": i, "own": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    return out


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``counted`` has the columns of :func:`failures`: at most 2^k rows a part,
    whatever the number of documents. ``shapley`` is the sum over all k! orders.
    """
    k = len(filters)
    every = (1 << k) - 1

    def removed_by_all_coalitions(value: str) -> Column:
        return F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(value)).otherwise(0)) for s in range(every + 1)))

    parts = counted.groupBy("part").agg(
        F.sum("n").alias("n"), *(removed_by_all_coalitions(v).alias(f"{v}_by") for v in ("n", "good", "toxic"))
    )
    weights, (rows, divisor) = kernel(k), solver(k)
    right = [sum((F.col("n_by")[s] * weights[s.bit_count()] for s in range(every) if s >> i & 1), F.lit(0)) for i in range(k)]
    parts = parts.withColumn("right", F.array(*right, F.col("n_by")[every]))
    summed = [sum(F.col("right")[j] * (factorial(k) * c) for j, c in enumerate(row)) for row in rows]
    parts = parts.withColumn("values", F.array(*(F.call_function("div", s, F.lit(divisor)) for s in summed)))
    table = F.from_json(
        F.lit(json.dumps(steps(filters))), "array<struct<filter_order: string, step: int, i: int, own: int, before: int, after: int>>"
    )
    lines = parts.select("*", F.inline(table))

    def difference(value: str) -> Column:
        by = F.col(f"{value}_by")
        return by[F.col("after")] - by[F.col("before")]

    by = F.col("n_by")
    return lines.select(
        "part", "filter_order", "step", (F.col("n") - by[F.col("after")]).alias("kept"), difference("n").alias("removed"),
        (by[F.col("own")] - difference("n")).alias("redundant"),
        (by[every] - by[F.lit(every) - F.col("own")]).alias("unique_fails"),
        difference("good").alias("good_lost"), difference("toxic").alias("toxic_lost"), F.col("values")[F.col("i")].alias("shapley"),
    )
