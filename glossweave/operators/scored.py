"""All pairs of a block that can reach a layered score, where neither sound nor meaning alone is selective.

With most weight on ancestry a pair of one language needs little sound and
little meaning; then the pairs to return are a share of all pairs, and any join
by keys or by vectors meets nearly all of them, with all their columns. Here a
block is cut into chunks of bounded size, and a task compares two of them: the
cosines are one matrix product, and so is the number of letters that two forms
have in common, which bounds how alike they can sound. Edit distances are taken
only where that bound leaves room, and only what reaches the score leaves a task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from glossweave.functions import phonetic, scores
from glossweave.functions.tree import chance_matrix
from glossweave.functions.vectors import norm
from glossweave.session import materialize

CHUNK = 2048
# Rows of a chunk that are compared at once, pairs whose distances are taken at once, and letters beyond which they are not taken.
_ROWS, _PAIRS, _LETTERS = 256, 8192, 64
_COLUMNS = 512
_TOLERANCE = 1e-9


def letter_counts(forms: list[list[str]], columns: dict) -> np.ndarray:
    """A row per form; the product of two rows is at least the number of letters they have in common.

    Every occurrence of a letter after the first is a column of its own.
    Columns beyond a bound are folded, which can only raise a product.
    """
    out = np.zeros((len(forms), _COLUMNS), "float32")
    for i, form in enumerate(forms):
        for letter, n in Counter(form).items():
            for k in range(n):
                out[i, columns.setdefault((letter, k), len(columns)) % _COLUMNS] += 1
    return out


def letter_codes(forms: list[list[str]], codes: dict, width: int) -> np.ndarray:
    """A row of numbers per form, as far as ``width`` letters."""
    out = np.full((len(forms), width), -1, "int32")
    for i, form in enumerate(forms):
        out[i, : len(form[:width])] = [codes.setdefault(g, len(codes)) for g in form[:width]]
    return out


def edit_distances(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of numbers, pair by pair."""
    n, m = int(size_a.max(initial=0)), int(size_b.max(initial=0))
    a, b = np.ascontiguousarray(a[:, :n].T), np.ascontiguousarray(b[:, :m].T)
    place = np.arange(m + 1, dtype="int16")[:, None]
    row = np.repeat(place, len(size_a), axis=1)
    every = np.arange(len(size_a))
    out = row[size_b, every].astype("int16")
    for i in range(n):
        best = row + np.int16(1)
        best[1:] = np.minimum(best[1:], row[:-1] + (a[i] != b))
        # An insertion costs one letter more than the place before it.
        row = np.minimum.accumulate(best - place, axis=0) + place
        done = size_a == i + 1
        out[done] = row[size_b[done], every[done]]
    return out


def possible_pairs(
    entries: DataFrame, weights: tuple[float, float, float], threshold: float, block: str, fields: tuple[str, ...], chunk: int = CHUNK
) -> DataFrame:
    """Pairs whose layered score reaches ``threshold`` but for rounding: block, ``a``, ``b`` (structs of ``fields``), phonetic, semantic.

    Rows that lack block, form, id or vector have no pairs; a vector of length zero has no cosine.
    """
    rows = entries.filter(F.col(block).isNotNull() & F.col("ipa").isNotNull() & F.col("id").isNotNull() & norm(F.col("embedding")).isNotNull())
    rows = materialize(rows.select(
        block, *fields, F.size("embedding").alias("_dim"), phonetic.graphemes(F.col("ipa")).alias("_parts"), F.monotonically_increasing_id().alias("_row")
    ), "rows").withColumn("_size", F.size("_parts"))
    meaning_share, sound_share, origin_share = weights
    rest = scores.NO_EVIDENCE_ORIGIN

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["_i"].iloc[0], group["_j"].iloc[0]
        sides, columns, codes = [], {}, {}
        named = lambda part: [c if isinstance(c, str) else None for c in part["language"]]
        number = {c: n for n, c in enumerate(dict.fromkeys(named(group)))}
        for own in (i, j):
            part = group[group["_own"] == own]
            forms = [list(p) for p in part["_parts"]]
            v = np.array(part["_v"].tolist(), "float64").reshape(len(part), group["_dim"].iloc[0])
            size = np.array([len(f) for f in forms], "int64")
            width = min(int(size.max(initial=0)), _LETTERS)
            sides.append((
                v, np.sqrt((v * v).sum(1)), letter_counts(forms, columns), letter_codes(forms, codes, width), size,
                np.array([number[c] for c in named(part)], "int64"), part["_row"].to_numpy(),
            ))
        # Per pair of languages: what meaning and sound add to a score.
        gain = origin_share * (chance_matrix(list(number)) - rest) / 2
        by_meaning, by_sound = meaning_share + gain, sound_share + gain
        base = origin_share * rest
        enough = threshold - _TOLERANCE
        (va, na, ca, la, sa, ta, ra), (vb, nb, cb, lb, sb, tb, rb) = sides
        found = []
        for start in range(0, len(ra) if len(rb) else 0, _ROWS):
            at = slice(start, start + _ROWS)
            with np.errstate(all="ignore"):
                lengths = na[at, None] * nb
                meaning = va[at] @ vb.T / lengths
            longest = np.maximum(sa[at, None], sb)
            common = np.minimum(ca[at] @ cb.T, np.minimum(sa[at, None], sb))
            alike = np.where(longest == 0, 1.0, common / np.maximum(longest, 1))
            pair = (ta[at, None], tb[None, :])
            # A cosine that is no number reaches every score, as in SQL.
            with np.errstate(all="ignore"):
                keep = ~(base + by_meaning[pair] * meaning + np.maximum(by_sound, 0)[pair] * alike < enough) & (lengths != 0)
            if i == j:
                keep &= np.arange(len(rb))[None, :] > np.arange(len(ra))[at, None]
            x, y = np.nonzero(keep)
            s, top = meaning[x, y], longest[x, y]
            order = np.argsort(top, kind="stable")
            x, y, s, top = x[order] + start, y[order], s[order], top[order]
            for k in range(0, len(x), _PAIRS):
                p, q, n = x[k : k + _PAIRS], y[k : k + _PAIRS], top[k : k + _PAIRS]
                short = n <= _LETTERS
                d = np.zeros(len(p))
                d[short] = edit_distances(la[p[short]], lb[q[short]], sa[p[short]], sb[q[short]])
                sound, both = 1 - d / np.maximum(n, 1), (ta[p], tb[q])
                with np.errstate(all="ignore"):
                    # Longer forms are left to the columns that compute the score.
                    inside = ~short | ~(base + by_meaning[both] * s[k : k + _PAIRS] + by_sound[both] * sound < enough)
                found.append((ra[p[inside]], rb[q[inside]], s[k : k + _PAIRS][inside]))
        x, y, s = (np.concatenate(c) for c in zip(*found)) if found else ([], [], [])
        return pd.DataFrame({"_x": pd.Series(x, dtype="int64"), "_y": pd.Series(y, dtype="int64"), "semantic": pd.Series(s, dtype="float64")})

    keys = [block, "_dim"]
    chunks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    own = F.pmod(F.xxhash64("_row"), F.col("_chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda k: F.struct(F.least("_own", k).alias("_i"), F.greatest("_own", k).alias("_j")))
    tasks = rows.join(chunks, keys).withColumn("_own", own).select(
        *keys, "_row", "language", "_parts", F.col("embedding").cast("array<double>").alias("_v"), "_own", F.inline(meets)
    )
    near = materialize(tasks.groupBy(*keys, "_i", "_j").applyInPandas(compare, "_x long, _y long, semantic double"), "possible")
    side = lambda s: rows.select(
        *([block] if s == "x" else []), F.col("_row").alias(f"_{s}"), F.struct(*fields).alias(f"_entry_{s}"), F.col("_size").alias(f"_size_{s}")
    )
    met = near.join(side("x"), "_x").join(side("y"), "_y").filter("_entry_x.id <> _entry_y.id")
    sound = phonetic.similarity(F.col("_entry_x.ipa"), F.col("_entry_y.ipa"), F.col("_size_x"), F.col("_size_y"))
    swap = F.col("_entry_x.id") > F.col("_entry_y.id")
    first, second = F.col("_entry_x"), F.col("_entry_y")
    return met.select(
        block, F.when(swap, second).otherwise(first).alias("a"), F.when(swap, first).otherwise(second).alias("b"), sound.alias("phonetic"),
        # On the way from pandas what is no number becomes null.
        F.coalesce("semantic", F.lit(float("nan"))).alias("semantic"),
    )
