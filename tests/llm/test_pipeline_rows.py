"""Stages decide per row: null ids, repeated ids, empty texts, columns of the stage's own names."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from glossweave.llm import decontaminate, minhash, packing, toxicity
from glossweave.llm.common import Encoder


def say(start, n=60):
    return " ".join(f"w{start}x{k}" for k in range(n))


def test_copies_and_benchmark_by_row(spark, tmp_path):
    item = say(900, 30)
    rows = [
        (5, say(1), "a"), (3, say(1) + " tail", "b"), (None, say(1), "c"),  # one group: the row of id 3 stays
        (7, say(2), "d"), (7, say(3), "e"), (8, say(3), "f"),  # id 7 stands on two texts
        (9, say(4), "g"), (9, say(4), "g"),  # equal rows
        (None, "", "h"), (None, "", "h"), (10, None, "i"), (10, None, "i"),  # no copies
        (None, say(5), "j"), (None, say(5), "k"),
        (11, say(6) + " " + item, "l"), (11, say(7), "m"), (None, item, "n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(3).sortWithinPartitions("__row")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.without_copies(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    names = sorted(r["__row"] for r in left.collect())
    assert "".join(names).replace("j", "*").replace("k", "*") == "bdeghhii*lmn"
    clean = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert sorted(r["__row"] for r in clean.collect()) == sorted("abcdefgghhiijkm")
    none = docs.limit(0)
    assert corpus_pipeline.without_copies(spark, none, str(tmp_path)).count() == 0
    assert corpus_pipeline.without_benchmark(spark, none, str(tmp_path)).count() == 0


def test_every_stage_hands_texts_over_in_small_batches(spark, sf, monkeypatch):
    key, met = "spark.sql.execution.arrow.maxBytesPerBatch", []
    usual = spark.conf.get(key)

    def python(df):
        return "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()

    for module in (corpus_pipeline, toxicity, minhash, decontaminate, packing):
        def written(df, label="step", real=module.materialize):
            if python(df):
                met.append((label, spark.conf.get(key)))
            return real(df, label)

        monkeypatch.setattr(module, "materialize", written)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        # Whoever writes the outcome does so under the session's own bound; packing's last step reads numbers alone.
        assert name == "packing" or not python(out)
        assert spark.conf.get(key) == usual
    assert {"bags", "clean", "sketches", "full", "items", "gone", "pieces"} <= {label for label, _ in met}
    assert {size for _, size in met} == {"4m"}


def test_packing_with_a_small_memory_is_the_same(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1).unionByName(
        spark.createDataFrame([(-1, "one <|endoftext|> two"), (-2, "three  <| four")], "doc_id long, text string"), allowMissingColumns=True)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    usual = packing.pack(docs, path, added=True).select(columns)
    small = packing.pack(docs, path, added=True, most=50, chars=1000).select(columns)
    assert sorted(usual.collect()) == sorted(small.collect())
    texts = [r["text"] for r in docs.select("text").collect()]
    enc = Encoder(path, most=50, added=True)
    lib = Tokenizer.from_file(path)
    sizes = []
    for text in texts:
        assert enc.encode([text]) == [np.array(lib.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()]
        sizes.append(len(enc.numbers))
    # At most one text's pieces beyond the bound.
    assert max(sizes) <= 51 + max(len(set(re.split(r"\s", t or ""))) * 2 + 2 for t in texts)
