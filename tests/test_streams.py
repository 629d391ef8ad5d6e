import gzip
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from glossweave.plans.catalog import QUERIES, SQL
from glossweave.plans import ingest
from glossweave.operators import concepts
from glossweave.streaming import jobs

SCHEMA = "id long, headword string, ipa string, language string, definition string, etymology string, pos_tag string"


def feed(folder, name, rows, broken=False):
    with gzip.open(folder / f"{name}.json.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(map(json.dumps, rows)) + ("\n{oops" if broken else ""))


def row(i, word, language="en", definition="a definition of some length"):
    return {"id": i, "headword": word, "ipa": word.lower(), "language": language, "definition": definition}


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    feed(where, "1", [row(1, "*Water"), row(2, "fire"), row(3, "short", definition="tiny")], broken=True)
    feed(where, "2", [row(4, "water"), row(5, "Feuer", "German")])
    return where


def test_stream_equals_batch(spark, folder):
    stream = jobs.stream_through(jobs.clean_stream(jobs.json_stream(spark, str(folder), SCHEMA, 1)), "t")
    batch = jobs.clean_stream(spark.read.schema(SCHEMA).json(str(folder), mode="DROPMALFORMED"))
    columns = ["id", "headword", "language", "definition", "data_quality"]
    assert sorted(stream.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert {r.headword for r in stream.collect()} == {"water", "fire", "feuer"}


def test_stream_keeps_one_row_per_key(spark, folder):
    stream = jobs.clean_stream(jobs.json_stream(spark, str(folder), SCHEMA, 1)).select("headword", "language")
    out = jobs.stream_through(jobs.first_per_key(stream, ["headword", "language"]), "d")
    assert sorted(map(tuple, out.collect())) == [("feuer", "de"), ("fire", "en"), ("water", "en")]


def test_resume_stores_each_key_once(spark, folder, tmp_path):
    path, state, marks = (str(tmp_path / x) for x in ("out", "state", "marks"))

    def run():
        stream = jobs.json_stream(spark, str(folder), SCHEMA, 1).select("id", F.lower("headword").alias("w"))
        jobs.run_batches(stream, jobs.store_new(path, ["w"], ["id"], marks), state).awaitTermination()
        return sorted((r.w, r.id) for r in spark.read.parquet(path).collect())

    first = run()
    assert run() == first
    feed(folder, "3", [row(9, "fire"), row(10, "earth"), row(11, "earth")])
    assert run() == sorted([*first, ("earth", 10)])
    last = spark.read.parquet(marks).orderBy(F.desc("batch")).first()
    assert (last.processed, last.succeeded, last.skipped) == (3, 1, 2)


def test_progress_listener(spark, folder, tmp_path):
    watch = jobs.Progress(total=10)
    spark.streams.addListener(watch)
    query = jobs.run_to_table(jobs.json_stream(spark, str(folder), SCHEMA), str(tmp_path / "o"), str(tmp_path / "s"))
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(watch)
    assert watch.rows >= 5 and watch.remaining == 10 - watch.rows


def test_full_run(spark, folder):
    records = spark.read.schema(SCHEMA).json(str(folder), mode="DROPMALFORMED")
    watched, counts = ingest.counted(records, "loaded", german=F.col("language") == "German")
    known = concepts.hashed_vectors(spark.createDataFrame([("c1", "a definition of some length")], "concept_id string, t string"), "t")
    out = ingest.full_run(watched, ["id"], known.withColumnRenamed("embedding", "centroid"))
    rows = {r.headword: r for r in out.collect()}
    assert set(rows) == {"water", "fire", "feuer"} and rows["feuer"].language == "de"
    assert all(r.concept_id == "c1" and r.concept_confidence == pytest.approx(1.0) for r in rows.values())
    assert rows["fire"].data_quality == pytest.approx(0.8) and rows["fire"].validation_errors is None
    assert counts.get["rows"] >= 5


def test_reprocess(spark):
    raw = spark.createDataFrame([("s", "water"), ("t", "fire")], "source_id string, headword string")
    read = lambda df: df.select("headword", F.lit("x").alias("ipa"), F.lit("en").alias("language"), F.lit("long enough text").alias("definition"))
    assert [r.headword for r in ingest.reprocess(raw, read, ["headword"], "v2", "t").collect()] == ["fire"]
    assert {r.pipeline_version for r in ingest.reprocess(raw, read, ["headword"], "v2").collect()} == {"v2"}


def test_ingest_file_adds_each_record_once(spark, tmp_path):
    lines = [
        {"word": "Water", "lang_code": "en", "senses": [{"glosses": ["a clear liquid"]}]},
        {"word": "water", "lang_code": "en", "senses": [{"glosses": ["another liquid"]}]},
        {"word": "fire", "lang_code": "en", "senses": [{"glosses": ["hot"]}]},
    ]
    source, store = tmp_path / "d.jsonl", str(tmp_path / "store")
    source.write_text("\n".join(map(json.dumps, lines)), encoding="utf-8")
    first = ingest.ingest_file(spark, "jsonl", str(source), "wiktionary", store)
    assert first == {"loaded": 3, "raw_added": 3, "raw_duplicates": 0, "saved": 1, "rejected_or_duplicate": 2}
    lines.append({"word": "Feuer", "lang_code": "de", "senses": [{"glosses": ["flames and heat"]}]})
    source.write_text("\n".join(map(json.dumps, lines)), encoding="utf-8")
    again = ingest.ingest_file(spark, "jsonl", str(source), "wiktionary", store)
    assert (again["raw_added"], again["raw_duplicates"], again["saved"]) == (1, 3, 1)
    saved = spark.read.parquet(f"{store}/entries")
    assert {(r.headword, r.language) for r in saved.collect()} == {("water", "en"), ("feuer", "de")}
    assert saved.filter("source_id = 'wiktionary' and data_quality > 0").count() == 2


def test_arrivals_are_batches_however_many_files(spark, tmp_path):
    """The counts of the chain's batches do not depend on how the cluster deals rows into files."""
    rows = [(i, "en" if i % 2 else "de", f"Wort number {i} of many words", "web") for i in range(40)] + [(40, "en", "A b", "web"), (41, "en", "A", "web"), (42, "x1", "Wort number of many", "web")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, float(i)], i % 3) for i in range(20)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["stream_progress"](spark, str(tmp_path)).first()
    assert tuple(found) == (43, 2, 1, 2)
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert con.execute(SQL["stream_progress"]).fetchone() == tuple(found)
