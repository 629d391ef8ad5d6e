import random

from pyspark.sql import functions as F

from glossweave.operators import dedup, entries as ops, windows
from glossweave.operators.skew import heavy_keys, spread_join
from glossweave.sources import sinks


def test_spread_join_equals_plain_join_for_every_kind(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([0, 0, 0, 1, 2, 3, 9]), i) for i in range(400)], "k int, v int")
    right = spark.createDataFrame([(k, f"w{k}{j}") for k in (0, 1, 2, 5) for j in range(2)], "k int, w string")
    assert heavy_keys(left, ["k"], 100).count() == 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        for rows in (1, 100, 10_000):
            assert sorted(map(tuple, spread_join(left, right, ["k"], how, 8, rows).collect()), key=repr) == plain


def test_dedup(spark):
    rows = [(3, "a", "en"), (1, "a", "en"), (2, "a", None), (5, "a", None), (4, "b", "en"), (6, "a", "")]
    df = spark.createDataFrame(rows, "i int, w string, l string")
    assert {r.i for r in dedup.keep_first(df, ["w", "l"], ["i"]).collect()} == {1, 2, 4, 6}
    for spread in (1, 1000):
        assert {tuple(r) for r in dedup.duplicate_pairs(df, ["w", "l"], "i", spread).collect()} == {(1, 3), (2, 5)}
    assert {r.i for r in dedup.keep_last(df, ["w"], ["i"]).collect()} == {4, 6}


def test_row_index_windows_and_batches(spark):
    values = random.Random(2).sample(range(10_000), 137)
    df = spark.createDataFrame([(v, f"v{v}") for v in values], "k int, x string").repartition(5)
    order = sorted(values)
    indexed = {r.k: r.row_index for r in windows.with_row_index(df, ["k"]).collect()}
    assert indexed == {v: i for i, v in enumerate(order)}
    for block in (5, 16, 1000):
        got = {r.start: r["items"] for r in windows.sliding_windows(df, ["k"], "x", 4, block).collect()}
        assert got == {i: [f"v{v}" for v in order[i:i + 4]] for i in range(len(order) - 3)}
    sizes = [r["count"] for r in windows.batches(df, ["k"], 50).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [50, 50, 37]


def test_upsert_and_deletes(spark):
    target = spark.createDataFrame([("a", "x", "en"), ("b", "y", "de")], "id string, headword string, language string")
    changes = spark.createDataFrame([("b", "z", "fr", 1), ("b", "w", "fr", 2), ("c", "n", "fr", 1)], "id string, headword string, language string, at int")
    out = sinks.upsert(target, changes, ["id"], ["headword"], order=["at"], touch={"language": F.concat("language", F.lit("!"))})
    assert {tuple(r) for r in out.collect()} == {("a", "x", "en"), ("b", "w", "de!"), ("c", "n", "fr")}
    assert [r.id for r in sinks.append_new(target, changes, ["id"], ["at"]).collect()] == ["c"]
    assert [r.id for r in sinks.delete_ids(target, changes).collect()] == ["a"]
    sourced = target.withColumn("source_id", F.when(F.col("id") == "a", "s"))
    assert [r.id for r in sinks.delete_source(sourced, "s").collect()] == ["b"]
    vectors = spark.createDataFrame([("a", "new")], "id string, headword string")
    assert {tuple(r) for r in ops.update_by_id(target, vectors, ["headword"]).collect()} == {("a", "new", "en"), ("b", "y", "de")}
    assert ops.matched_count(target, vectors).first()[0] == 1


def test_missing_languages(spark):
    raw = spark.createDataFrame([("en", "English"), ("xx", "B"), ("xx", "A"), ("", "C"), (None, "D")], "lang_code string, lang string")
    known = spark.createDataFrame([("en",)], "iso_code string")
    assert [tuple(r) for r in sinks.missing_languages(raw, known).collect()] == [("xx", "A", "Unknown", None)]


def test_stored_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "en"), ("b", "de")], "id string, language string")
    sinks.write_entries(df, f"{tmp_path}/e")
    sinks.write_entries(df, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 4
    sinks.write_json_lines(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.append_table(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_views(spark):
    sources = spark.createDataFrame([("s1", "One", "high"), ("s2", "Two", "low")], "id string, name string, quality string")
    entries = spark.createDataFrame(
        [("a", "s1", "en", "c1", 0.9, None, "2024-01-01"), ("b", "s1", "de", "c1", 0.4, ["bad"], "2024-01-02")],
        "id string, source_id string, language string, concept_id string, data_quality double, validation_errors array<string>, updated_at string",
    )
    got = {r.source_id: r for r in ops.quality_summary(sources, entries).collect()}
    assert (got["s1"].total_entries, got["s1"].high_quality_count, got["s1"].low_quality_count, got["s1"].entries_with_errors) == (2, 1, 1, 1)
    assert got["s2"].total_entries == 0 and got["s2"].avg_entry_quality is None
    concepts = spark.createDataFrame([("c1", "WATER", 2, 0.9), ("c2", "FIRE", 0, 0.5)], "id string, label string, size long, confidence double")
    stats = {r.concept_id: r for r in ops.concept_statistics(concepts, entries).collect()}
    assert stats["c1"].languages_represented == ["de", "en"] and stats["c2"].num_languages == 0
    assert ops.concept_by_label(concepts, "wat").first().id == "c1"
    edges = spark.createDataFrame([("a", "b", 0.9)], "entry_a string, entry_b string, combined_score double")
    words = entries.withColumns({"headword": F.col("id"), "ipa": F.col("id")})
    assert ops.similar_entries(edges, words, "b").first().entry_id == "a"
    diff = ops.lexical_differences(edges, words, concepts)
    row = diff.first()
    assert (row.language_a, row.form_a, row.language_b, row.form_b, row.concept_label) == ("de", "b", "en", "a", "WATER")
    assert ops.unscored_pairs(words, diff).first().asDict()["unscored"] == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "ru", "n", "s"), (2, "en", None, "t"), (3, "pl", "n", "s")], "id int, language string, pos_tag string, source_id string")
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(ops.query(df, language="ru", pos_tag=None)) == [1] and ids(ops.query(df)) == [1, 2, 3]
    assert ids(ops.in_branch(df, "slavic")) == [1, 3] and ids(ops.in_branch(df, "anatolian")) == []
    assert ids(ops.scan(df, "s", 1)) == [3] and ids(ops.by_id(df, 2)) == [2]
    assert ids(ops.page(df, ["id"], 1, 1)) == [2]


def test_coverage(spark):
    langs = spark.createDataFrame([("en", "ie"), ("la", "ie"), ("fi", "ur")], "iso_code string, family string")
    expected = spark.createDataFrame([("en", "english"), ("la", None), ("fi", "finnish")], "iso_code string, file string")
    present = spark.createDataFrame([("english",), ("klingon",)], "file string")
    covered = ops.coverage(langs, expected, present)
    assert {r.iso_code: r.status for r in covered.collect()} == {"en": "COMPLETE", "la": "ALTERNATIVE", "fi": "MISSING"}
    total = ops.coverage_summary(covered).filter("family is null").first()
    assert (total.total, total.with_data, total.percent, total.missing) == (3, 2, 66.7, ["fi"])
    assert [r.file for r in ops.unmapped_files(present, expected).collect()] == ["klingon"]


def test_progress_row(spark):
    batch = spark.createDataFrame([(True, False, False), (False, True, False)], "succeeded boolean, failed boolean, skipped boolean")
    row = sinks.progress_row(batch).first()
    assert (row.total, row.processed, row.succeeded, row.failed, row.skipped) == (2, 2, 1, 1, 0)
