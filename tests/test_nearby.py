"""Near vectors, pairs by meaning, and leaders on an edge table against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import clusters, nearby, pairs


def cos(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("pivots, chunk", [(1, 7), (9, 16), (64, 1000)])
def test_near_pairs(spark, pivots, chunk):
    r = np.random.default_rng(3)
    middles = r.normal(size=(6, 5)) * 3
    vectors = [(middles[i % 6] + r.normal(size=5) * (0.1 if i % 3 else 1)).tolist() for i in range(150)] + [[0.0] * 5, [0.0] * 5]
    rows = [(i, "x" if i % 4 else "y", v) for i, v in enumerate(vectors)] + [(900, "x", None), (901, "x", [float("nan")] * 5), (902, "x", [None] * 5)]
    df = spark.createDataFrame(rows, "id long, g string, vector array<double>")
    got = {(x.g, x.a, x.b): x.distance for x in nearby.near_pairs(df, 1.3, ("g",), pivots=pivots, chunk=chunk).collect()}
    want = {
        (g, i, j): np.linalg.norm(np.array(u) - v) for (i, g, u), (j, h, v) in combinations(rows[:152], 2)
        if g == h and np.linalg.norm(np.array(u) - v) <= 1.3
    }
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(want) > 200
    assert nearby.near_pairs(df.limit(0), 1.0).count() == 0


def entries(spark, n=90):
    r = random.Random(7)
    rows = []
    for i in range(n):
        base = [3.0 * (k == i % 4) for k in range(6)]
        rows.append((i, f"c{i % 2}", f"w{i}", "".join(r.choice("abcd") for _ in range(r.randint(3, 6))), r.choice(["en", "de", "fr", "xx"]),
                     base if i % 9 == 0 else [x + r.gauss(0, 1) for x in base]))
    rows += [(900, "c0", "z", "abc", "en", [0.0] * 6), (901, None, "z", "abc", "en", [1.0] * 6), (902, "c1", "n", "abc", "en", None)]
    return rows, spark.createDataFrame(rows, "id long, concept_id string, headword string, ipa string, language string, embedding array<double>")


def test_pairs_by_meaning(spark):
    rows, df = entries(spark)
    got = {(x.a.id, x.b.id) for x in pairs.meaning_pairs(df, 0.5).select("a", "b").collect()}
    want = {(a[0], b[0]) for a, b in combinations(rows[:90], 2) if a[1] == b[1] and cos(a[5], b[5]) >= 0.5}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("mode, threshold", [("semantic", 0.6), ("historical", 0.45), ("cognate", 0.55), ("balanced", 0.5)])
def test_scored_pairs_lose_none(spark, mode, threshold):
    """All pairs above the threshold, also such as sound unlike."""
    rows, df = entries(spark)
    every = df.alias("l").join(df.alias("r"), (F.col("l.concept_id") == F.col("r.concept_id")) & (F.col("l.id") < F.col("r.id"))).filter(
        "l.embedding is not null and r.embedding is not null"
    )
    side = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in pairs.PAIR_FIELDS])
    from glossweave.functions import phonetic
    every = every.select(F.col("l.concept_id"), side("l").alias("a"), side("r").alias("b")).withColumn(
        "phonetic", phonetic.similarity(F.col("a.ipa"), F.col("b.ipa"), F.length("a.ipa"), F.length("b.ipa")))
    shown = lambda d: {(x[0], x[1]): round(x[2], 9) for x in d.select("a.id", "b.id", "combined").collect()}
    want = shown(pairs.layered_scores(every, mode).filter(F.col("combined") >= threshold))
    out = pairs.scored_pairs(df, mode, threshold)
    assert shown(out) == want and len(want) > 20
    if mode in ("semantic", "historical"):
        assert out.filter("phonetic < 0.6").count() > 10


def one_by_one(ids, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leader = {}
    for i in sorted(ids):
        if i not in leader:
            leader[i] = i
            for j in near.get(i, ()):
                leader.setdefault(j, i)
    return leader


def test_leaders_on_an_edge_table(spark):
    r = random.Random(1)
    for ids, edges in [
        (range(60), [(r.randrange(60), r.randrange(60)) for _ in range(90)]),
        (range(12), [(i, i + 1) for i in range(11)]),
        (range(3001), [(0, i) for i in range(1, 3000)] + [(2999, 3000), (5, 3000), (5, 0)]),
        (range(5), []),
    ]:
        table = spark.createDataFrame([(i,) for i in ids], "id long")
        links = spark.createDataFrame(edges, "a long, b long")
        got = {x.id: x.leader for x in clusters.greedy_leaders(table, links).collect()}
        assert got == one_by_one(ids, [e for e in edges if e[0] != e[1]])
