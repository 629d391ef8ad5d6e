"""All pairs of a block bounded by score, against brute force."""

import random
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions import phonetic, scores, tree
from glossweave.operators import pairs, scored

FIELDS = "id long, concept_id string, headword string, ipa string, language string, embedding array<double>"


def rows():
    r, g = random.Random(11), np.random.default_rng(11)
    letters, codes = ["a", "b", "e", "ß", "é"], ["en", "de", "fr", "hu", "", None]
    out = []
    for i in range(120):
        form = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 5, 8, 70])))
        vector = g.normal(size=6).round(2).tolist()
        out.append((i, f"c{i % 2}", "w", form, codes[i * 7 // 3 % 6], vector))
    # Vectors of no length, of another length, with nulls or without a number; and rows that lack a field.
    out += [(200, "c0", "w", "abe", "en", [0.0] * 6), (201, "c0", "w", "abe", "en", [1.0] * 5), (202, "c0", "w", "abe", "en", [1.0] * 5 + [None])]
    out += [(203, "c0", "w", "abe", "en", [float("nan")] * 6), (204, "c0", "w", None, "en", [1.0] * 6), (205, None, "w", "abe", "en", [1.0] * 6)]
    return out + [(206, "c0", "w", "abe", "en", None), (207, "c0", "w", "abe", "en", [])]


@pytest.mark.parametrize("threshold, chunk", [(0.3, 2), (0.55, 13)])
def test_pairs_that_reach_a_score(spark, threshold, chunk):
    df = spark.createDataFrame(rows(), FIELDS).localCheckpoint()
    every = df.alias("l").join(df.alias("r"), (F.col("l.concept_id") == F.col("r.concept_id")) & (F.col("l.id") < F.col("r.id")))
    side = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in pairs.PAIR_FIELDS])
    every = every.filter("l.ipa is not null and r.ipa is not null").select(F.col("l.concept_id"), side("l").alias("a"), side("r").alias("b"))
    every = every.withColumn("phonetic", phonetic.similarity(F.col("a.ipa"), F.col("b.ipa")))
    shown = lambda d: {(x[0], x[1]): str(round(x[2], 9)) for x in d.select("a.id", "b.id", "combined").collect()}
    want = shown(pairs.layered_scores(every, "historical").filter(F.col("combined") >= threshold))
    weights = scores.WEIGHTS["historical"]
    near = scored.possible_pairs(df, weights, threshold, "concept_id", pairs.PAIR_FIELDS, chunk=chunk)
    got = pairs.layered_scores(near, "historical", semantic=F.col("semantic")).filter(F.col("combined") >= threshold)
    assert shown(got) == want and len(want) > 50 and "nan" in want.values()


def test_a_low_cut_meets_results_only(spark, monkeypatch):
    """Where most cosines are above the cut, pairs are not met by their vectors one and all."""
    df = spark.createDataFrame([x for x in rows() if x[3] is not None and len(x[3]) < 20 and x[0] < 200], FIELDS).localCheckpoint()
    met = []
    layered = pairs.layered_scores
    monkeypatch.setattr(pairs, "layered_scores", lambda p, *a, **k: (met.append(p), layered(p, *a, **k))[1])
    found = pairs.scored_pairs(df, "historical", 0.3).count()
    assert pairs.meaning_cut(scores.WEIGHTS["historical"], 0.3, 0.6) < 0 < found
    assert met[0].count() == found


def test_edit_distances_and_common_letters(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(0, 9))) for _ in range(400)]
    both = list(zip(words[:200], words[200:]))
    codes, columns = {}, {}
    a, b = (scored.letter_codes([list(p[k]) for p in both], codes, 9) for k in (0, 1))
    sizes = [np.array([len(p[k]) for p in both]) for k in (0, 1)]
    got = scored.edit_distances(a, b, *sizes).tolist()
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(both)], "i long, a string, b string")
    assert got == [x.d for x in df.select("i", F.levenshtein("a", "b").alias("d")).orderBy("i").collect()]
    x, y = (scored.letter_counts([list(p[k]) for p in both], columns) for k in (0, 1))
    assert (np.maximum(*sizes) - (x * y).sum(1) <= got).all()


def test_chances_of_languages(spark):
    codes = sorted(c for c, *_ in tree.language_rows())
    found = {(x.lang_a, x.lang_b): x.prior_probability for x in tree.language_pairs(spark).collect()}
    chance = tree.chance_matrix([*codes, "xx", "yy", None, None])
    for (i, a), (j, b) in combinations_with_replacement(enumerate(codes), 2):
        assert chance[i, j] == chance[j, i] == found.get((a, b), 1.0)
    k = len(codes)
    assert chance[k, k] == 1 and (chance[k, [0, k + 1, k + 2]] == 0.001).all() and chance[k + 2, k + 2] == chance[k + 2, k + 3] == 0.001
