import zlib

import public_tokenizers

from glossweave.llm import queries, rans


def test_ids_are_digested_where_they_are_decoded(spark):
    """The query's checksums are those of the decoded ids, and one Python step decodes and digests."""
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["op3_rans"](spark, sf)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = rans.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), added=True).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert {tuple(r) for r in found.collect()} == {(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in whole}
