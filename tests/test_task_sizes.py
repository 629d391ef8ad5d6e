"""What tasks are spared: work on every word, uncompiled joins, batches of very many whole texts."""

import public_tokenizers
from pyspark.sql import functions as F

from glossweave.llm import packing
from glossweave.operators import pairs
from glossweave.session import small_batches


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_distinct_forms_are_taken_apart(spark, monkeypatch):
    seen = []
    real = pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df, label="step": seen.append(plan_of(df)) or real(df, label))
    words = spark.createDataFrame([("",), (None,), ("wasserweg",), ("wasserwege",), ("étéété",), ("étéétés",)], "ipa string")
    found = pairs.similar_forms(words.filter("ipa IS NULL OR ipa <> 'x'"), "ipa", 0.85)
    assert {(r.form_a, r.form_b) for r in found.collect()} == {("wasserweg", "wasserwege"), ("étéété", "étéétés")}
    forms = seen[0]
    assert r"(\X)" not in forms[forms.rindex("HashAggregate"):]
    joins = [line for line in plan_of(found).split("\n") if "Join [" in line and "Inner" in line]
    assert joins and all("levenshtein" in line and "lambdafunction" not in line and r"(\X)" not in line for line in joins)


def test_whole_texts_come_in_small_batches(spark, monkeypatch):
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, most = spark.conf.get(key), []
    real = packing.materialize

    def written(df, label="step"):
        if label == "pieces":
            most.append(docs.mapInArrow(count, "n long").agg(F.max("n")).first()[0])
        return real(df, label)

    monkeypatch.setattr(packing, "materialize", written)
    assert packing.pack(docs.limit(3), public_tokenizers.path("byte_bpe_50k.json")).count() == 3
    assert most[0] < 6e6 and spark.conf.get(key) == before
    try:
        with small_batches(spark, "1m"):
            raise KeyError
    except KeyError:
        assert spark.conf.get(key) == before
