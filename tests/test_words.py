import itertools
import random

import pytest
from pyspark.sql import functions as F

from glossweave.functions import phonetic, scores, tree
from glossweave.operators import clusters, pairs
from glossweave.plans import difference


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def words(n, seed=1, letters="abc", longest=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def two(spark, rows):
    return spark.createDataFrame(rows, "a string, b string")


@pytest.mark.parametrize("a, b, wanted", [
    ("test", "test", 1.0), ("pater", "mater", 0.8), ("pater", "pitar", 0.6), ("", "", 1.0), ("", "x", 0.0),
    ("r̥a", "ra", 0.5), ("wódr̥", "wodr", 0.5),
])
def test_similarity(spark, a, b, wanted):
    out = two(spark, [(a, b)]).select(phonetic.similarity(F.col("a"), F.col("b")), phonetic.distance(F.col("a"), F.col("b"))).first()
    assert out[0] == wanted and out[1] == 1.0 - wanted


def test_similarity_and_common_ratio_match_brute_force(spark):
    rng = random.Random(3)
    pool = words(60) + ["r̥at", "rat̥", "ã̄b"]
    rows = [(rng.choice(pool), rng.choice(pool)) for _ in range(300)]
    out = two(spark, rows).select(
        "a", "b", phonetic.similarity(F.col("a"), F.col("b")).alias("s"), phonetic.common_ratio(F.col("a"), F.col("b")).alias("c"),
        phonetic.graphemes(F.col("a")).alias("ga"), phonetic.graphemes(F.col("b")).alias("gb"),
    ).collect()
    for r in out:
        longest = max(len(r.ga), len(r.gb))
        assert r.s == 1.0 - edit(r.ga, r.gb) / longest
        assert r.c == common(r.ga, r.gb) / longest


def test_alignment_and_correspondences(spark):
    row = two(spark, [("abc", "adc")]).select(phonetic.align(F.col("a"), F.col("b")).alias("x")).first().x
    assert row.cost == 1.0 and len(row.aligned_a) == 3
    empty = two(spark, [("", "x")]).select(phonetic.align(F.col("a"), F.col("b")).alias("x")).first().x
    assert empty.cost == 0.0 and empty.ops == [] and empty.aligned_b == ["x"]
    counted = pairs.correspondence_counts(two(spark, [("pater", "pitar"), ("mater", "mitar")]), "a", "b")
    assert {tuple(r) for r in counted.collect()} == {("a", "i", 2), ("e", "a", 2)}


def test_feature_distance(spark):
    table = {"p": [1] * 24, "b": [1] * 18 + [0] * 6, "a": [0] * 24}
    rows = [("pa", "ba"), ("", ""), ("", "pa"), ("pa", "pa")]
    out = two(spark, rows).select(phonetic.feature_distance(F.col("a"), F.col("b"), table).alias("d")).collect()
    assert [r.d for r in out] == [0.125, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("cut", [0.3, 0.5, 0.6, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("spread_rows", [1, 100_000])
def test_similar_forms_equals_all_pairs(spark, cut, spread_rows):
    pool = words(120, seed=5) + words(40, seed=6, letters="ab", longest=14)
    pool = sorted(set(pool))
    df = spark.createDataFrame([(w, i % 2) for i, w in enumerate(pool)] + [(pool[0], 0)] * 50, "w string, g int")
    found = {(r.g, r.form_a, r.form_b) for r in pairs.similar_forms(df, "w", cut, ("g",), spread_rows).collect()}
    wanted = {
        (g, a, b) for g in (0, 1) for a, b in itertools.combinations(pool[g::2], 2)
        if 1.0 - edit(a, b) / max(len(a), len(b)) >= cut
    }
    assert found == wanted


def test_ordered_pairs(spark):
    df = two(spark, [("b", "a"), ("a", "b"), ("a", "a")])
    assert [tuple(r) for r in pairs.ordered_pairs(df, "a", "b").collect()] == [("a", "b")]


@pytest.mark.parametrize("a, b, depth_sum, chance, lca", [
    ("en", "ta", 15, 0.001, 15), ("fi", "ta", 15, 0.001, 15), ("en", "fi", 15, 0.001, 15), ("en", "de", 4, 0.15, 1),
    ("en", "ru", 5, 0.08, 5), ("ta", "te", 2, 0.3, 2), ("ru", "uk", 6, 0.08, 1), ("xx", "en", 999, 0.001, 999), ("en", "en", 0, 1.0, 0),
])
def test_tree_distance(spark, a, b, depth_sum, chance, lca):
    df = two(spark, [(a, b)])
    row = tree.add_tree_distance(df, "a", "b", "d").select("d", scores.origin_chance(F.col("d")).alias("c")).first()
    assert (row.d, row.c) == (depth_sum, chance)
    assert tree.add_tree_distance(df, "a", "b", "d", "lca").first().d == lca


def test_tree_facts(spark):
    assert len(tree.language_rows()) == 57
    assert set(tree.branch_codes("slavic")) == set("ru uk be pl cs sk bg mk sl hr sr".split())
    assert tree.branch_codes("anatolian") == []
    rows = {r.iso_code: r for r in tree.languages(spark).collect()}
    assert (rows["ru"].branch, rows["ru"].family, rows["ru"].depth) == ("balto_slavic", "indo-european", 3)


def lexicon(spark, n=40, seed=2):
    rng = random.Random(seed)
    rows = []
    for i, w in enumerate(words(n, seed, "abcd", 6)):
        rows.append((i, w, w, ["en", "de", "ru", "ta"][i % 4], f"meaning {w}", [rng.gauss(0, 1) for _ in range(4)], f"c{i % 2}"))
    return spark.createDataFrame(rows, "id long, headword string, ipa string, language string, definition string, embedding array<double>, concept_id string")


def test_entry_pairs_and_layered_scores(spark):
    words_ = lexicon(spark)
    got = pairs.layered_scores(pairs.entry_pairs(words_, 0.5), "cognate").select(
        F.col("a.id").alias("x"), F.col("b.id").alias("y"), "phonetic", "semantic", "combined", "tree_distance", "etymological").collect()
    rows = words_.collect()
    wanted = {
        (a.id, b.id): 1 - edit(a.ipa, b.ipa) / max(len(a.ipa), len(b.ipa))
        for a, b in itertools.combinations(rows, 2)
        if a.concept_id == b.concept_id and 1 - edit(a.ipa, b.ipa) / max(len(a.ipa), len(b.ipa)) >= 0.5
    }
    assert {(r.x, r.y): r.phonetic for r in got} == wanted
    for r in got:
        evidence = (r.semantic + r.phonetic) / 2
        chance = {0: 1.0, 4: 0.15, 5: 0.08, 15: 0.001}[r.tree_distance]
        origin = chance * evidence + (1 - evidence) * 0.1
        assert r.etymological == pytest.approx(origin)
        assert r.combined == pytest.approx(0.3 * r.semantic + 0.6 * r.phonetic + 0.1 * origin)


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_leader_clusters_equal_the_one_by_one_procedure(spark, batch):
    words_ = lexicon(spark, 30)
    cut = 0.45
    fields = ["id", "ipa", "language", "size", "unit"]
    slim = difference.comparable(words_).select("concept_id", *fields)
    got = {r.id: r.leader for r in clusters.leader_clusters(
        slim, "concept_id", lambda p: difference.cognate_score(p, cut), cut, batch).collect()}
    every = slim.select("concept_id", F.struct(*fields).alias("a"))
    other = slim.select("concept_id", F.struct(*fields).alias("b"))
    scored = difference.cognate_score(every.join(other, "concept_id").filter("a.id < b.id"), -1.0)
    score = {(r.x, r.y): r.combined for r in scored.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), "combined").collect()}
    wanted = {}
    rows = sorted(words_.collect(), key=lambda r: r.id)
    for lead in rows:
        if lead.id in wanted:
            continue
        wanted[lead.id] = lead.id
        for r in rows:
            if r.id not in wanted and r.concept_id == lead.concept_id and score[(lead.id, r.id)] >= cut:
                wanted[r.id] = lead.id
    assert got == wanted


def test_difference_report(spark):
    rows = [
        (1, "tak", "tak", "uk", "yes", [1.0, 0.0], "yes"), (2, "da", "da", "ru", "yes", [1.0, 0.1], "yes"),
        (3, "tak", "tak", "pl", "yes", [1.0, 0.0], "yes"), (4, "da", "da", "bg", "yes", [1.0, 0.1], "yes"),
        (5, "aam", "aam", "ta", "yes", [0.2, 1.0], "yes"),
    ]
    df = spark.createDataFrame(rows, "id long, headword string, ipa string, language string, definition string, embedding array<double>, concept_id string")
    row = difference.explain(df, "yes", "uk", "ru").first()
    assert (row.language_a, row.language_b, row.form_a, row.form_b) == ("ru", "uk", "da", "tak")
    assert row.cognates_a == {"bg": "da"} and row.cognates_b == {"pl": "tak"} and row.tree_distance == 6
    assert row.explanation == (
        "RU uses 'da' while UK uses 'tak' for the same concept. 'da' clusters with forms in: bg. "
        "'tak' clusters with forms in: pl. This difference aligns with distant phylogenetic relationship (distance=6). "
        "This variation exists within the balto_slavic branch, possibly due to substrate influence, borrowing, or lexical replacement."
    )
    other = difference.explain(df, "yes", "ta", "ru").first()
    assert "different families (indo-european vs dravidian)" in other.explanation


def test_language_pair_table(spark):
    table = tree.language_pairs(spark)
    assert table.count() == 57 * 56 // 2
    row = table.filter("lang_a = 'ru' and lang_b = 'uk'").first()
    assert (row.tree_distance, row.prior_probability) == (6, 0.08)


def test_distance_is_exact_for_thousands_of_distinct_graphemes(spark):
    from glossweave.functions.phonetic import edit_distance

    a = [chr(0x4E00 + k) + "́" for k in range(3001)]
    b = [chr(0x8E00 + k) + "́" if k % 6 == 0 and k < 3000 else x for k, x in enumerate(a)]
    df = spark.createDataFrame([("".join(a), "".join(b))], "a string, b string")
    from pyspark.sql import functions as F

    assert df.select(edit_distance(F.col("a"), F.col("b"))).first()[0] == 500


def test_long_forms_meet_by_few_keys(spark):
    """All pairs within two edits of long words, of plain letters and others, from fewer keys than there are pairs of letters."""
    rng = random.Random(11)
    words = set()
    for n in (6, 7, 8, 9, 13, 14, 15, 18, 19):
        for letters in ("ab", "abcdefgh", "aé̃o"):
            base = [rng.choice(letters) for _ in range(n)]
            words.add("".join(base))
            for _ in range(25):
                other = list(base)
                for _ in range(rng.randint(1, 3)):
                    at, kind = rng.randrange(len(other)), rng.randrange(3)
                    if kind == 0:
                        other[at] = rng.choice(letters)
                    elif kind == 1:
                        other.insert(at, rng.choice(letters))
                    else:
                        del other[at]
                words.add("".join(other))
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    sizes = df.select("w", F.size(phonetic.graphemes(F.col("w"))).alias("n")).collect()
    a, b = (df.select(F.col("w").alias(c)) for c in "ab")
    every = a.crossJoin(b).filter("a < b").withColumns({"d": phonetic.edit_distance(F.col("a"), F.col("b"))})
    size = {r.w: r.n for r in sizes}
    want = {(r.a, r.b) for r in every.collect() if 1 - r.d / max(size[r.a], size[r.b]) >= 0.85}
    assert {(r.form_a, r.form_b) for r in pairs.similar_forms(df, "w", 0.85).collect()} == want and len(want) > 500
    one = spark.createDataFrame([("abcdefghijklmno", 15, 15, 2)], "_form string, _n int, _m int, _t int").withColumns(
        {"_parts": phonetic.graphemes(F.col("_form")), "_plain": F.lit(True), "_long": F.lit(True)}
    )
    assert pairs._with_windows_left_out(one, ()).select("_key").distinct().count() <= 10
