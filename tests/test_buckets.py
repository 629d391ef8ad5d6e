"""Bucketed tables and the streaming chain: what is rewritten, and what a restart gives."""

import os

import pytest
from pyspark.sql import functions as F

from glossweave.plans.catalog.streams import letter_vectors
from glossweave.sources import buckets
from glossweave.streaming import chain, jobs

ROW = "id long, word string, note string, changed long"


def table(spark, path):
    return sorted(tuple(r) for r in buckets.current(spark, path, ROW).collect())


def put(spark, path, rows, number):
    df = spark.createDataFrame(rows, "id long, word string, note string")
    return buckets.upsert_batch(spark, path, ROW, df, ["id"], ["word"], 4, number, touch={"changed": F.lit(number).cast("long")})


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert buckets.current(spark, path, ROW).count() == 0
    put(spark, path, [(i, "a", "first") for i in range(40)], 0)
    before = {str(f): os.stat(f).st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    touched = put(spark, path, [(3, "b", "second"), (100, "new", None)], 1)
    after = {str(f): os.stat(f).st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    assert len(touched) <= 2 and before.items() <= after.items()
    assert {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(b) for b in touched}
    want = sorted([(i, "b" if i == 3 else "a", "first", 1 if i == 3 else None) for i in range(40)] + [(100, "new", None, None)], key=lambda r: r[0])
    assert table(spark, path) == want
    # A batch that runs again, also with other rows, replaces what it wrote itself.
    put(spark, path, [(3, "c", "x"), (100, "newer", None)], 1)
    assert [r for r in table(spark, path) if r[0] in (3, 100)] == [(3, "c", "first", 1), (100, "newer", None, None)]
    assert put(spark, path, [], 2) == set()


def source(spark, folder):
    """Four files whose entries repeat, fail the gate or lack a word."""
    for f in range(4):
        rows = [(f * 100 + i, f"Word{(f * 37 + i) % 60}", "w", "en", f"text of a longer word {chr(97 + i % 26)} {i % 13}", None, "noun", "s") for i in range(80)]
        rows += [(f * 100 + 90, "short", "s", "en", "tiny", None, None, "s"), (f * 100 + 91, "", "x", "en", "no word at all here", None, None, "s")]
        df = spark.createDataFrame(rows, "doc long, headword string, ipa string, language string, definition string, etymology string, pos_tag string, source_id string")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{f}")
    return f"{folder}/*"


def test_a_stopped_chain_goes_on_and_equals_the_batch_run(spark, tmp_path):
    files = source(spark, str(tmp_path / "in"))
    whole = spark.read.parquet(files)
    centers = spark.createDataFrame([("c1", [1.0] + [0.0] * 25), ("c2", [0.0] * 19 + [1.0] + [0.0] * 6)], "concept_id string, centroid array<double>")

    def handler(name):
        return chain.Chain(str(tmp_path / name), centers, letter_vectors, ("doc",), 4, progress=str(tmp_path / f"{name}-progress"))

    class Stopping(chain.Chain):
        """Fails once in its third batch, after the table was written and before the batch is committed."""

        def report(self, judged, done, number):
            if number == 2:
                raise RuntimeError("stopped")
            super().report(judged, done, number)

    def stream():
        return jobs.table_stream(spark, files, files_per_batch=1)

    stopping = Stopping(str(tmp_path / "a"), centers, letter_vectors, ("doc",), 4, progress=str(tmp_path / "a-progress"))
    with pytest.raises(Exception, match="stopped"):
        chain.run_chain(stream(), stopping, str(tmp_path / "a-state"))
    assert 0 < chain.stored_entries(spark, str(tmp_path / "a")).count()
    chain.run_chain(stream(), handler("a"), str(tmp_path / "a-state"))
    handler("b")(whole, 0)
    columns = ["id", "headword", "definition", "embedding", "concept_id", "concept_confidence", "data_quality"]
    rows = lambda name: sorted(map(tuple, chain.stored_entries(spark, str(tmp_path / name)).select(*columns).collect()))
    assert rows("a") == rows("b") and len(rows("a")) == len({r[0] for r in rows("a")})
    totals = chain.progress_totals(spark, str(tmp_path / "a-progress")).first()
    assert (totals.processed, totals.failed, totals.skipped, totals.batches) == (328, 4, 4, 4)
    again = chain.Chain(str(tmp_path / "b"), centers, letter_vectors, ("doc",), 4, progress=str(tmp_path / "b-progress"), skip_existing=True)
    again(whole, 1)
    assert spark.read.parquet(str(tmp_path / "b-progress")).filter("batch = 1").first().written == 0


def test_new_keys_pass_without_a_join_of_whole_rows(spark, tmp_path, monkeypatch):
    """An upsert joins stored rows and changes on the few keys that both have, which are written first."""
    seen, write = [], buckets.materialize

    def counting(df, label):
        out = write(df, label)
        seen.append((label, out.columns, out.count()))
        return out

    monkeypatch.setattr(buckets, "materialize", counting)
    path, schema = str(tmp_path / "t"), "k string, v string"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    buckets.upsert_batch(spark, path, schema, rows(("a", "1"), ("b", "1"), (None, "1")), ["k"], ["v"], 2, 0)
    buckets.upsert_batch(spark, path, schema, rows(("b", "2"), ("c", "2"), (None, "2")), ["k"], ["v"], 2, 1)
    found = sorted(map(str, buckets.current(spark, path, schema).collect()))
    assert found == sorted(map(str, rows(("a", "1"), ("b", "2"), ("c", "2"), (None, "1"), (None, "2")).collect()))
    assert [x for x in seen if x[0] == "known"] == [("known", ["k"], 0), ("known", ["k"], 1)]
