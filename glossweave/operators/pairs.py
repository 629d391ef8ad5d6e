"""Pairs of similar words, found without comparing all words with all words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossweave.functions import phonetic, scores
from glossweave.functions.tree import add_tree_distance
from glossweave.functions.vectors import cosine
from glossweave.operators.nearby import similar_vectors
from glossweave.operators.scored import possible_pairs
from glossweave.operators.skew import spread_join
from glossweave.session import materialize, settle, share

_TOLERANCE = 1e-9

# Edits up to which forms meet by the letters they keep; a short form of n letters has n over that many keys.
_FEW_EDITS = 2

# Letters per edit from which a form is cut into windows.
_CUT_FROM = 6

# In place of a distance that is not known yet.
_NOT_PLAIN = -2


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair once with the smaller id first; no self pairs."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (
        df.filter(F.col(a) != F.col(b))
        .withColumns({a: low, b: high})
        .dropDuplicates([a, b])
    )


def similar_forms(
    words: DataFrame,
    form: str,
    min_similarity: float,
    block: tuple[str, ...] = (),
    spread_rows: int = 100_000,
) -> DataFrame:
    """All pairs of distinct forms with phonetic similarity >= ``min_similarity``.

    Exact. Two forms of lengths n <= m that differ by at most t edits keep m - t
    letters in common, in order. For one or two edits these are the join keys:
    all that is left of a form without so many of its letters, or, where it is
    long, without so many windows of two or three letters (:func:`_with_windows_left_out`),
    which are fewer. Few forms share one, however large the vocabulary, so
    candidates grow with the result. For more edits such keys would be too
    many; there the forms share one of t + 1 even pieces of the shorter form,
    shifted by no more than the edits allow. The distance is computed on key
    matches only, and copies of a form count once.

    Returns ``block`` columns, form_a < form_b and similarity.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must lie in (0, 1]")
    slack = 1.0 - min_similarity
    col = F.col
    edits = lambda m: F.floor(F.lit(slack) * m + _TOLERANCE).cast("int")
    # Written once: both sides and the search for heavy keys read the distinct
    # forms again, and the words behind them may be whole texts. Empty forms go by
    # a plain comparison: a filter on the graphemes would be pushed below the
    # distinct and take every word of every text apart.
    forms = (
        words.filter(col(form) != "")
        .select(*block, col(form).alias("_form"))
        .distinct()
        .withColumn("_parts", phonetic.graphemes(col("_form")))
        .withColumn("_size", F.size("_parts"))
        .withColumn("_plain", F.length("_form") == col("_size"))
    )
    forms = share(materialize(forms, "forms"))
    few = f"_t BETWEEN 1 AND {_FEW_EDITS}"
    begin = lambda i: F.floor(col("_n") * i / (col("_t") + 1)).cast("int")
    piece = lambda at, size: F.array_join(F.slice("_parts", at + 1, size), "")
    # _n and _m: lengths of the shorter and longer form; _t: edits they may
    # differ by; _i: number of the piece; _p and _w: its place and width.
    lengths = (
        lambda df: df
        .withColumn("_i", F.explode(F.sequence(F.lit(0), col("_t"))))
        .withColumn("_p", begin(col("_i")))
        .withColumn("_w", begin(col("_i") + 1) - col("_p"))
    )
    longest = F.floor(col("_size") / min_similarity + _TOLERANCE).cast("int")
    sized = (
        forms.withColumn("_n", col("_size"))
        .withColumn("_m", F.explode(F.sequence("_size", longest)))
        .withColumn("_t", edits(col("_m")))
        .filter(col("_m") - col("_n") <= col("_t"))
        .withColumn("_long", F.lit(False))
    )
    own = forms.withColumns({"_n": col("_size"), "_m": col("_size"), "_t": edits(col("_size")), "_long": F.lit(True)})
    # One number is the key, so that rows are sorted by it alone; whatever meets by chance is told apart by its distance.
    def kept(df: DataFrame, side: str, size: str) -> DataFrame:
        found = [col("_form").alias(f"_{side}"), col("_plain").alias(f"_plain_{side}"), size, "_key"]
        cut, whole = df.filter(few).filter(f"_m >= {_CUT_FROM} * _t"), df.filter(few).filter(f"_m < {_CUT_FROM} * _t")
        return _with_windows_left_out(cut, block).select(*block, *found).unionByName(
            _with_letters_left_out(whole, block).select(*block, *found)
        )

    by_letters = (
        kept(sized, "short", "_n").join(kept(own, "long", "_m"), ["_key", *block])
        .filter(col("_n") <= col("_m")).withColumn("_t", edits(col("_m")))
    )
    short = lengths(sized.filter(f"_t > {_FEW_EDITS}")).select(
        *block, col("_form").alias("_short"), col("_plain").alias("_plain_short"), "_n", "_m", "_i", "_t",
        piece(col("_p"), col("_w")).alias("_piece"),
    )
    shortest = F.greatest(F.lit(1), col("_size") - edits(col("_size")))
    gap = col("_m") - col("_n")
    back = lambda spare: F.floor(spare / 2).cast("int")
    long = (
        lengths(
            own.filter(f"_t > {_FEW_EDITS}").withColumn("_n", F.explode(F.sequence(shortest, col("_size"))))
        )
        .withColumn("_first", F.greatest(F.lit(0), col("_p") - back(col("_t") - gap)))
        .withColumn("_last", F.least(col("_m") - col("_w"), col("_p") + back(col("_t") + gap)))
        .filter("_first <= _last")
        .withColumn("_pieces", F.transform(F.sequence("_first", "_last"), lambda q: piece(q, col("_w"))))
        .select(
            *block, col("_form").alias("_long"), col("_plain").alias("_plain_long"), "_n", "_m", "_i",
            F.explode(F.array_distinct("_pieces")).alias("_piece"),
        )
    )
    by_piece = spread_join(short, long, [*block, "_n", "_m", "_i", "_piece"], min_rows=spread_rows)
    names = [*block, "_short", "_plain_short", "_long", "_plain_long", "_n", "_m", "_t"]
    met = by_letters.select(*names).unionByName(by_piece.select(*names)).filter(
        (col("_n") < col("_m")) | (col("_short") < col("_long"))
    )
    # The bounded distance gives up beyond _t edits and answers -1. It alone is the condition of the join, once per match;
    # forms with letters of several code points are told apart behind it, or their lambdas would keep the join from being compiled.
    bounded = F.call_function("levenshtein", col("_short"), col("_long"), col("_t"))
    near = F.when(col("_plain_short") & col("_plain_long"), bounded).otherwise(_NOT_PLAIN)
    whole = phonetic.edit_distance(col("_short"), col("_long"))
    return (
        settle(met.withColumn("_near", near).filter("_near <> -1").select(*block, "_short", "_long", "_m", "_near"))
        .withColumn("_d", F.when(col("_near") == _NOT_PLAIN, whole).otherwise(col("_near")))
        .withColumn("similarity", 1.0 - col("_d") / col("_m"))
        .filter(col("similarity") >= min_similarity)
        .select(
            *block, F.least("_short", "_long").alias("form_a"), F.greatest("_short", "_long").alias("form_b"), "similarity"
        )
        .distinct()
    )


def _with_letters_left_out(forms: DataFrame, block: tuple[str, ...] = ()) -> DataFrame:
    """A row and its ``_key`` for every way to leave _n - _m + _t (0 to 2) letters out of a form."""
    n, p, q = F.col("_n"), F.col("_p"), F.col("_q")
    drop = n - F.col("_m") + F.col("_t")
    # Places from 0; place n is behind the form, where nothing is left out.
    nowhere = F.array(n)
    rows = forms.withColumn("_p", F.explode(F.when(drop == 0, nowhere).otherwise(F.sequence(F.lit(0), n - 1))))
    rows = rows.withColumn("_q", F.explode(F.when(drop < 2, nowhere).when(p < n - 1, F.sequence(p + 1, n - 1))))
    return rows.withColumn("_key", F.xxhash64("_m", *block, _without((p, p + 1), (q, q + 1))))


def _with_windows_left_out(forms: DataFrame, block: tuple[str, ...] = ()) -> DataFrame:
    """A row and its ``_key`` for every way to leave _t (1 or 2) windows out of a form.

    Windows of even width are laid over the longer form, of _m letters. Every edit falls into one of
    them, the others are the same in both forms. What stands in the shorter one for a window that holds
    edits is longer or shorter by _x (first window left out) or _y (second) letters.
    """
    m, n, i, j, x, y = (F.col(c) for c in ("_m", "_n", "_i", "_j", "_x", "_y"))
    one = F.col("_t") == 1
    width = F.when(one, 2).otherwise(3)
    last = F.ceil(m / width).cast("int") - 1
    rows = forms.withColumn("_i", F.explode(F.sequence(F.lit(0), last - F.when(one, 0).otherwise(1))))
    rows = rows.withColumn("_j", F.explode(F.when(one, F.array(last + 1)).otherwise(F.sequence(i + 1, last))))
    ways = lambda *pairs: F.array(*[F.struct(F.lit(a).alias("_x"), F.lit(b).alias("_y")) for a, b in pairs])
    # Two edits in one window are met once: the next one is left out with it, or the one before the last.
    close = F.when((j == last) & (i == last - 1), ways((-1, -1), (-2, 0), (0, -2))).when(j == i + 1, ways((-1, -1), (-2, 0)))
    short = (
        F.when(one, F.when(n == m, ways((0, 0))).otherwise(ways((-1, 0))))
        .when(F.col("_long"), ways((0, 0)))
        .when(n == m, ways((0, 0), (1, -1), (-1, 1))).when(n == m - 1, ways((-1, 0), (0, -1)))
        .otherwise(F.coalesce(close, ways((-1, -1))))
    )
    rows = rows.select("*", F.inline(short))
    end = lambda k: F.least(width * (k + 1), m)
    first, second = (width * i, end(i) + x), (F.least(width * j, m) + x, end(j) + x + y)
    first, second = (first, (F.when(one, n).otherwise(second[0]), F.when(one, n).otherwise(second[1])))
    fits = (first[0] <= first[1]) & (second[0] <= second[1])
    return rows.filter(fits).withColumn("_key", F.xxhash64("_m", *block, "_i", "_j", _without(first, second)))


def _without(first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """The letters of a form outside of two spans, each from a place up to another."""
    size = F.col("_n")
    (a, b), (c, d) = first, second
    between = F.greatest(c - b, F.lit(0))
    letters = F.concat(F.substring("_form", F.lit(1), a), F.substring("_form", b + 1, between), F.substring("_form", d + 1, size))
    parts = F.concat(F.slice("_parts", F.lit(1), a), F.slice("_parts", b + 1, between), F.slice("_parts", d + 1, size))
    return F.when(F.col("_plain"), letters).otherwise(F.array_join(parts, ""))


PAIR_FIELDS = ("id", "headword", "ipa", "language", "embedding")


def entry_pairs(
    entries: DataFrame, min_similarity: float, block: str = "concept_id", fields: tuple[str, ...] = PAIR_FIELDS
) -> DataFrame:
    """Pairs of deduplicated entries of one block that sound alike.

    ``entries`` hold one row per (headword, language). Equal forms then meet
    once per language, so no group of copies is paired with itself.
    The table is read several times, so give a stored one. Columns: block,
    ``a`` and ``b`` (structs of ``fields``, a.id < b.id), phonetic.
    """
    kept = entries.select(block, *fields).filter(F.col(block).isNotNull() & F.col("ipa").isNotNull())
    near = similar_forms(kept, "ipa", min_similarity, (block,))
    same = kept.select(block, F.col("ipa").alias("form_a"), F.col("ipa").alias("form_b")).distinct()
    links = near.unionByName(same.withColumn("similarity", F.lit(1.0)))
    side = lambda s: kept.select(
        block, F.col("ipa").alias(f"form_{s}"), F.struct(*fields).alias(s)
    )
    met = links.join(side("a"), [block, "form_a"]).join(side("b"), [block, "form_b"])
    swap = F.col("a.id") > F.col("b.id")
    apart = (F.col("form_a") != F.col("form_b")) | (F.col("a.id") < F.col("b.id"))
    return met.filter(apart).select(
        block,
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.col("similarity").alias("phonetic"),
    )


def meaning_pairs(
    entries: DataFrame, min_cosine: float, block: str = "concept_id", fields: tuple[str, ...] = PAIR_FIELDS
) -> DataFrame:
    """Pairs of entries of one block that mean alike, whatever they sound like.

    The counterpart of :func:`entry_pairs`, with the same columns.
    """
    kept = entries.select(block, *fields).filter(F.col(block).isNotNull() & F.col("ipa").isNotNull() & F.col("embedding").isNotNull())
    near = similar_vectors(kept, min_cosine, (block,)).select("a", "b")
    side = lambda s: kept.select(*([block] if s == "a" else []), F.col("id").alias(s), F.struct(*fields).alias(f"_{s}"))
    met = near.join(side("a"), "a").join(side("b"), "b").select(block, F.col("_a").alias("a"), F.col("_b").alias("b"))
    sizes = [F.size(phonetic.graphemes(F.col(f"{s}.ipa"))) for s in "ab"]
    return met.withColumn("phonetic", phonetic.similarity(F.col("a.ipa"), F.col("b.ipa"), *sizes))


def meaning_cut(weights: tuple[float, float, float], threshold: float, sound: float) -> float:
    """Cosine below which no pair that sounds less alike than ``sound`` can reach the threshold.

    Evidence counts at most 0.1 + 0.9 (semantic + phonetic) / 2 as common origin.
    """
    meaning_share, sound_share, origin_share = weights
    rest = scores.NO_EVIDENCE_ORIGIN
    gain = (1 - rest) / 2
    return (threshold - sound_share * sound - origin_share * (rest + gain * sound)) / (meaning_share + origin_share * gain) - _TOLERANCE


def sound_cut(weights: tuple[float, float, float], threshold: float) -> float:
    """Sound below which no pair can reach the threshold, whatever it means."""
    meaning_share, sound_share, origin_share = weights
    rest = scores.NO_EVIDENCE_ORIGIN
    gain = (1 - rest) / 2
    return (threshold - meaning_share - origin_share * (rest + gain)) / (sound_share + origin_share * gain) - _TOLERANCE


def scored_pairs(
    entries: DataFrame, mode: str = "balanced", threshold: float = 0.6, sound: float | None = None, block: str = "concept_id",
    weights: tuple[float, float, float] | None = None,
) -> DataFrame:
    """All pairs of a block with a layered score of at least ``threshold``, of any sound.

    A pair either sounds alike (``sound`` or more) and comes from the pieces of
    its forms, or needs a cosine that follows from threshold and weights and
    comes from its vectors. Both joins are exact, so the result is. Where sound
    has most weight, the cut on sound may leave no pair to the vectors. A cosine
    that half of all pairs have picks none of them; then all pairs of a block are
    bounded at once (:func:`possible_pairs`).
    """
    chosen = weights or scores.WEIGHTS[mode]
    if sound is None:
        least = sound_cut(chosen, threshold)
        sound = least if least >= 0.3 else 0.6
    cut = meaning_cut(chosen, threshold, sound)
    if cut < -1:
        raise ValueError("the threshold lies below what any pair scores; every pair would be one")
    entries = entries.filter("embedding IS NOT NULL")
    if cut <= 0:
        met = possible_pairs(entries, chosen, threshold, block, PAIR_FIELDS)
        return layered_scores(met, mode, chosen, semantic=F.col("semantic")).filter(F.col("combined") >= threshold)
    met = entry_pairs(entries, sound, block)
    if cut <= 1:
        by_meaning = meaning_pairs(entries, cut, block).filter(F.col("phonetic") < sound)
        met = met.unionByName(by_meaning)
    return layered_scores(met, mode, chosen).filter(F.col("combined") >= threshold)


def layered_scores(
    pairs: DataFrame,
    mode: str = "balanced",
    weights: tuple[float, float, float] | None = None,
    tree_mode: str = "depth_sum",
    semantic: Column | None = None,
) -> DataFrame:
    """Three-layer score of pairs that carry ``a``, ``b`` and ``phonetic``."""
    chosen = weights or scores.WEIGHTS[mode]
    meaning = semantic if semantic is not None else cosine(F.col("a.embedding"), F.col("b.embedding"))
    flat = pairs.withColumns({
        "semantic": meaning,
        "language_a": F.col("a.language"),
        "language_b": F.col("b.language"),
    })
    flat = add_tree_distance(flat, "language_a", "language_b", mode=tree_mode)
    flat = flat.withColumn(
        "etymological", scores.etymological(F.col("semantic"), F.col("phonetic"), F.col("tree_distance"))
    ).withColumn("weights", scores.weights_map(chosen))
    return flat.withColumn(
        "combined",
        scores.layered(F.col("semantic"), F.col("phonetic"), F.col("etymological"), F.col("weights")),
    )


def similarity_edges(pairs: DataFrame) -> DataFrame:
    """Two-signal scores of pairs, in the layout of the edge table."""
    meaning = cosine(F.col("a.embedding"), F.col("b.embedding"))
    out = pairs.withColumn("semantic", meaning)
    combined = scores.two_signal(F.col("phonetic"), F.col("semantic"))
    return out.select(
        F.col("a.id").alias("entry_a"), F.col("b.id").alias("entry_b"),
        F.col("phonetic").alias("phonetic_score"), F.col("semantic").alias("semantic_score"),
        combined.alias("combined_score"), combined.alias("confidence"),
    )


def correspondence_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How often each sound of one side stands for each sound of the other."""
    aligned = pairs.select(phonetic.align(F.col(a), F.col(b)).alias("alignment"))
    rules = aligned.select(F.explode(phonetic.correspondences(F.col("alignment"))).alias("r"))
    return rules.groupBy(F.col("r.a").alias("sound_a"), F.col("r.b").alias("sound_b")).agg(
        F.count(F.lit(1)).alias("n")
    )
