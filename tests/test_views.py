from pyspark.sql import functions as F

from glossweave.plans import views


def test_sql_surface(spark):
    sources = spark.createDataFrame([("s1", "One", "high")], "id string, name string, quality string")
    entries = spark.createDataFrame(
        [("a", "s1", "en", "c1", 0.9, "water"), ("b", "s1", "de", "c1", 0.4, "wasser"), ("c", "s1", "nl", "c1", 0.4, "water")],
        "id string, source_id string, language string, concept_id string, data_quality double, headword string",
    ).withColumns({"ipa": F.col("headword"), "validation_errors": F.lit(None).cast("array<string>"), "updated_at": F.lit("2024")})
    concepts = spark.createDataFrame([("c1", "WATER", 3, 0.9)], "id string, label string, size long, confidence double")
    edges = spark.createDataFrame([("a", "b", 0.6), ("a", "c", 0.9)], "entry_a string, entry_b string, combined_score double")
    views.register(spark, sources, entries, concepts, edges)
    one = lambda q: spark.sql(q).collect()
    assert one("SELECT total_entries FROM data_quality_summary")[0][0] == 3
    assert one("SELECT num_languages FROM concept_statistics")[0][0] == 3
    assert {(r.form_a, r.form_b) for r in one("SELECT * FROM lexical_differences")} == {("wasser", "water"), ("water", "water")}
    assert [r.entry_id for r in one("SELECT * FROM find_similar_entries('a')")] == ["c", "b"]
    assert [r.entry_id for r in one("SELECT * FROM find_similar_entries('a', 1)")] == ["c"]
    assert round(one("SELECT compute_layered_similarity(1D, 0.5D, 0D, map('semantic', 0.4D, 'phonetic', 0.4D, 'etymological', 0.2D))")[0][0], 6) == 0.6
    assert round(one("SELECT compute_entry_quality(NULL, 'n', false, 1, 'short')")[0][0], 6) == 0.4
