import random
from itertools import combinations

from glossweave.operators import pairs
from glossweave.plans.catalog import graphs, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_word_of_every_text_takes_part(spark, tmp_path):
    rows = [
        (1, "Kurz. Zwischenstück und zwischenstuck,\nein Wasserweg", "de"),
        (2, "short Wasserwege zwischenstück", "en"), (3, None, "en"), (4, "", None), (5, "wasserwege", "de"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.form_a, r.form_b): r.similarity for r in words.phonetic_pairs(spark, str(tmp_path)).collect()}
    all_words = sorted({"kurz", "zwischenstück", "und", "zwischenstuck", "ein", "wasserweg", "short", "wasserwege"})
    alike = {(a, b): 1 - distance(a, b) / max(len(a), len(b)) for a, b in combinations(all_words, 2)}
    assert found == {k: round(v, 6) for k, v in alike.items() if v >= 0.85} and len(found) == 2
    within = {tuple(r)[:3] for r in words.vocabulary_pairs(spark, str(tmp_path)).collect()}
    assert within == {("de", "zwischenstuck", "zwischenstück"), ("de", "wasserweg", "wasserwege")}
    labels = {r.node: r.component for r in graphs.components(spark, str(tmp_path)).collect()}
    assert labels == {"zwischenstück": "zwischenstuck", "zwischenstuck": "zwischenstuck", "wasserweg": "wasserweg", "wasserwege": "wasserweg"}


def test_words_of_one_beginning_share_few_keys(spark):
    """Pieces would make every word of a common beginning meet every other one."""
    rng = random.Random(3)
    pool = sorted({"abcdefgh" + "".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(300)})
    forms = spark.createDataFrame([(w, list(w), True, 16, 16, 2) for w in pool], "_form string, _parts array<string>, _plain boolean, _n int, _m int, _t int")
    keys = pairs._with_letters_left_out(forms).select("_form", "_key").distinct()
    assert keys.count() > 100 * len(pool)
    assert keys.groupBy("_key").count().agg({"count": "max"}).first()[0] <= 3
    left, right = keys.toDF("a", "_key"), keys.toDF("b", "_key")
    met = left.join(right, "_key").filter("a < b").select("a", "b").distinct()
    assert met.filter("levenshtein(a, b) > 4").isEmpty()
