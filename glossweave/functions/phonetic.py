"""Sound-level comparison of two transcriptions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_TEXTS = T.ArrayType(T.StringType())
ALIGNMENT = T.StructType([
    T.StructField("aligned_a", _TEXTS), T.StructField("aligned_b", _TEXTS),
    T.StructField("ops", _TEXTS), T.StructField("cost", T.DoubleType()),
])

# One stand-in letter per distinct grapheme of a pair: all code points above the basic plane.
_FIRST, _MOST = 0x10000, 0x100000


def _stand_in(n: Column) -> Column:
    """Letter of the n-th grapheme, n from 1."""
    code = F.lpad(F.hex(n.cast("long") + (_FIRST - 1)), 8, F.lit("0"))
    return F.decode(F.unhex(code), "UTF-32")


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))


def edit_distance(a: Column, b: Column, size_a: Column | None = None, size_b: Column | None = None) -> Column:
    """Levenshtein distance in graphemes.

    The built-in counts code points. Where a text holds longer graphemes, both
    sides are first rewritten with one stand-in letter per distinct grapheme.
    Sizes (numbers of graphemes) that are known already spare taking the texts
    apart again for every pair.
    """
    ga, gb = graphemes(a), graphemes(b)
    size_a = F.size(ga) if size_a is None else size_a
    size_b = F.size(gb) if size_b is None else size_b
    plain = (F.length(a) == size_a) & (F.length(b) == size_b)
    kinds = F.array_distinct(F.concat(ga, gb))
    rewrite = lambda g, k: F.array_join(F.transform(g, lambda x: _stand_in(F.array_position(k, x))), "")
    too_many = F.raise_error(F.lit(f"more than {_MOST} distinct graphemes in one pair")).cast("int")
    # The list of graphemes is a value of its own, else it would be made again for every grapheme.
    exact = F.transform(
        F.array(kinds), lambda k: F.when(F.size(k) > _MOST, too_many).otherwise(F.levenshtein(rewrite(ga, k), rewrite(gb, k)))
    )[0]
    return F.when(plain, F.levenshtein(a, b)).otherwise(exact)


def similarity(a: Column, b: Column, size_a: Column | None = None, size_b: Column | None = None) -> Column:
    """1 for equal texts (two empty ones included), 0 for nothing in common."""
    size_a = F.size(graphemes(a)) if size_a is None else size_a
    size_b = F.size(graphemes(b)) if size_b is None else size_b
    longest = F.greatest(size_a, size_b)
    return F.when(longest == 0, 1.0).otherwise(1.0 - edit_distance(a, b, size_a, size_b) / longest)


def distance(a: Column, b: Column) -> Column:
    return 1.0 - similarity(a, b)


def _common_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence; row states are bits of one integer."""
    where: dict[str, int] = {}
    for i, g in enumerate(a):
        where[g] = where.get(g, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for g in b:
        hit = open_bits & where.get(g, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


@F.pandas_udf(T.DoubleType())
def _common_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [_common_length(list(x), list(y)) / max(len(x), len(y), 1) if len(x) or len(y) else 1.0
         for x, y in zip(a, b)],
        dtype="float64",
    )


def common_ratio(a: Column, b: Column) -> Column:
    """Longest common subsequence over the longer length."""
    return _common_ratio(graphemes(a), graphemes(b))


def _warp(a: list[str], b: list[str]) -> tuple[list[str], list[str], list[str], float]:
    if not a or not b:
        return list(a), list(b), [], 0.0
    mismatch = (np.asarray(a, object)[:, None] != np.asarray(b, object)[None, :]).astype(float)
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0.0
    for i, j in np.ndindex(mismatch.shape):
        total[i + 1, j + 1] = mismatch[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    steps = []
    i, j = len(a), len(b)
    while i or j:
        both = total[i - 1, j - 1] if i and j else np.inf
        up = total[i - 1, j] if i and j else (0.0 if i else np.inf)
        left = total[i, j - 1] if i and j else (0.0 if j else np.inf)
        if i and j and both <= min(up, left):
            i, j = i - 1, j - 1
            steps.append((a[i], b[j], "substitute" if mismatch[i, j] else "match"))
        elif up < left:
            i -= 1
            steps.append((a[i], "-", "delete"))
        else:
            j -= 1
            steps.append(("-", b[j], "insert"))
    top, bottom, ops = map(list, zip(*reversed(steps)))
    return top, bottom, ops, float(total[-1, -1])


@F.pandas_udf(ALIGNMENT)
def _align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [_warp(list(x), list(y)) for x, y in zip(a, b)]
    return pd.DataFrame(rows, columns=["aligned_a", "aligned_b", "ops", "cost"])


def align(a: Column, b: Column) -> Column:
    """Time-warping alignment with gaps shown as '-'."""
    return _align(graphemes(a), graphemes(b))


def correspondences(alignment: Column) -> Column:
    """Sound pairs (a, b) that an alignment substitutes for each other."""
    triples = F.arrays_zip(
        alignment["aligned_a"].alias("a"), alignment["aligned_b"].alias("b"), alignment["ops"].alias("op")
    )
    kept = F.filter(triples, lambda t: t["op"] == "substitute")
    return F.transform(kept, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))


def feature_distance(a: Column, b: Column, features: dict[str, list[int]]) -> Column:
    """Edit distance whose substitution cost is the share of differing features.

    ``features`` maps a segment to its feature values and goes to every task:
    it holds one row per sound, not per word. Unknown segments differ fully.
    """
    table = {g: np.asarray(v, dtype="int8") for g, v in features.items()}

    def cost(x: str, y: str) -> float:
        if x == y:
            return 0.0
        if x not in table or y not in table:
            return 1.0
        return float(np.mean(table[x] != table[y]))

    def one(x: list[str], y: list[str]) -> float:
        if len(x) == 0 or len(y) == 0:
            return float(len(x) != len(y))
        row = list(map(float, range(len(y) + 1)))
        for i, g in enumerate(x, 1):
            before, row = row, [float(i)]
            for j, h in enumerate(y, 1):
                row.append(min(before[j] + 1.0, row[-1] + 1.0, before[j - 1] + cost(g, h)))
        return row[-1] / max(len(x), len(y))

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")

    return run(graphemes(a), graphemes(b))
