"""One query for each operator, over its whole table, and SQL beside it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.llm import decontaminate, html_crf, interaction, licenses, minhash, packing, pii, ppm, rans, secrets, topk, toxicity, trie
from glossweave.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Only for the given tables; a deployment sets its own secret as spark.glossweave.pseudonym.key.
KEY = "a key of the deployment"


def pseudonym_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: the session's secret, or the known test key where none is set."""
    return spark.conf.get("spark.glossweave.pseudonym.key", None) or KEY


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""")
def op1_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_products(table(spark, sf, "embeddings"))


@query()
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = toxicity.train_and_score(docs, table(spark, sf, "labels"))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op3_rans(spark: SparkSession, sf: str) -> DataFrame:
    import zlib

    def digest(b):
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in b["ids"]], pa.int64())
        return pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    path = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return rans.round_trip(table(spark, sf, "documents"), path, end_id=2, added=True, view=digest, schema=schema)


@query()
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    out = secrets.linked_secrets(table(spark, sf, "documents"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"), "n_linked",
    )


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), named AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS x FROM named),
f AS (SELECT x, count(*) AS c FROM e GROUP BY x HAVING count(*) > 1),
r AS (SELECT e.rep, e.n, e.x, row_number() OVER (PARTITION BY e.rep ORDER BY coalesce(f.c, 1), e.x) AS i FROM e LEFT JOIN f USING (x)),
p AS (SELECT * FROM r WHERE i <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
both_sets AS (SELECT cand.a, cand.b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS k FROM cand JOIN named x ON x.rep = a JOIN named y ON y.rep = b),
edge AS (SELECT a, b FROM both_sets WHERE 100 * k >= 80 * (na + nb - k)),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT rep AS a, rep AS b FROM named UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN named n ON n.s = list_sort(s.s) LEFT JOIN comp c ON c.rep = n.rep
""")
def op5_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), size=2).drop("set_id")


@query()
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), pseudonym_key(spark))


@query()
def op7_ppm(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.scores(table(spark, sf, "documents"), order=5)


@query()
def op8_html(spark: SparkSession, sf: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf, "pages"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, i - 1 AS pos, w[i:i + 15] AS w FROM d, LATERAL (SELECT unnest(range(1, len(w) - 14)) AS i) WHERE len(w) >= 16),
bw AS (SELECT item_id, w[i:i + 15] AS w FROM b, LATERAL (SELECT unnest(range(1, len(w) - 14)) AS i) WHERE len(w) >= 16),
m AS (SELECT unnest([1, 1, 1, 5, 5, 9]) AS x, unnest([5, 9, 13, 9, 13, 13]) AS y),
dk AS (SELECT doc_id, pos, w, x, y, array_to_string(list_concat(w[x:x + 3], w[y:y + 3]), ' ') AS k FROM dw, m),
bk AS (SELECT item_id, w, x, y, array_to_string(list_concat(w[x:x + 3], w[y:y + 3]), ' ') AS k FROM bw, m),
hit AS (
  SELECT doc_id, item_id, pos, 16 AS size, list_sum(list_transform(range(1, 17), lambda i: (dk.w[i] <> bk.w[i])::INTEGER)) AS apart
  FROM dk JOIN bk USING (x, y, k)
  UNION ALL
  SELECT doc_id, item_id, i - 1 AS pos, len(b.w) AS size, 0 AS apart
  FROM b JOIN d ON len(d.w) >= len(b.w), LATERAL (SELECT unnest(range(1, len(d.w) - len(b.w) + 2)) AS i)
  WHERE len(b.w) BETWEEN 8 AND 15 AND d.w[i:i + len(b.w) - 1] = b.w
), place AS (SELECT doc_id, item_id, pos, max(size) AS size, min(apart) AS apart FROM hit WHERE apart <= 2 GROUP BY ALL)
SELECT doc_id, item_id, count(*)::BIGINT AS n_places, min(pos)::INTEGER AS first_token, max(pos + size)::INTEGER AS end_token,
       min(apart)::INTEGER AS mismatches FROM place GROUP BY doc_id, item_id
""")
def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, added=True)


@query("""
WITH t AS (
  SELECT conv_id, struct_pack(role := role, text := text) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ' ' || text)) AS r
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
c AS (
  SELECT conv_id, list(turn ORDER BY r) AS own, xor(4294967295::BIGINT, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(a, x)), 4294967295::BIGINT
  )) % 6 AS h FROM t GROUP BY conv_id
),
b AS (
  SELECT c.conv_id, list_concat(coalesce(base.own, [])[1:c.h], c.own[c.h + 1:]) AS turns
  FROM c LEFT JOIN c base ON base.conv_id = c.conv_id - c.conv_id % 100
),
m AS (SELECT conv_id, d, turns[1:d] AS seq, len(turns) = d AS ends FROM b, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
n AS (
  SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids,
         (count(*) - 1) * CASE WHEN d > 0 THEN length(seq[d].text) ELSE 0 END AS saving
  FROM m GROUP BY seq, d
),
p AS (SELECT n.*, parent.conv_id AS parent_conv_id FROM n LEFT JOIN n parent ON parent.d = n.d - 1 AND parent.seq = n.seq[1:n.d - 1]),
k AS (SELECT seq[1:d - 1] AS seq, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (
  SELECT u.seq[1:x.d] AS seq, x.d, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(u.saving) AS saved_tokens
  FROM n u LEFT JOIN k ON k.d = u.d AND k.seq = u.seq, LATERAL (SELECT unnest(range(u.d + 1)) AS d) x GROUP BY ALL
)
SELECT p.conv_id, p.d::BIGINT AS depth, p.parent_conv_id, p.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(p.ids) AS ends_sha256
FROM p LEFT JOIN k ON k.d = p.d AND k.seq = p.seq JOIN s ON s.d = p.d AND s.seq = p.seq
""")
def op11_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.nodes(table(spark, sf, "conversations")).drop("ref_conv_id", "ref_turn")


@query(rf"""
WITH t(k, label, base, n, least, i, word, fixed) AS (VALUES {licenses.template_values()}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
),
p AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
m AS (
  SELECT r, k, label, base, n, pos - i AS start, count(*) AS equal FROM p JOIN t USING (word)
  GROUP BY r, k, label, base, n, least, pos - i
  HAVING count(*) >= least AND count(*) FILTER (fixed) = (SELECT count(*) FROM t f WHERE f.k = any_value(t.k) AND f.fixed)
),
shown AS (
  SELECT DISTINCT r, label FROM m WHERE base OR NOT EXISTS (
    SELECT 1 FROM m o WHERE o.r = m.r AND o.label <> m.label AND o.n > m.n AND o.start <= m.start AND o.start + o.n >= m.start + m.n)
),
a AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, max(equal::DOUBLE / n) AS score, count(*) AS n_places
  FROM m GROUP BY r
),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM shown GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0) AS score, coalesce(n_places, 0) AS n_places
FROM d LEFT JOIN a USING (r) LEFT JOIN l USING (r)
""")
def op12_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS smallest FROM d
),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
                CASE WHEN 100 * capitals > 3 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                CASE WHEN doc_id > smallest THEN 'E' END) AS fails
  FROM w LEFT JOIN l USING (doc_id)
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
r AS (
  SELECT part, good, toxic, fails, filter_order,
         list_min(list_transform(string_split(fails, ''), lambda x: strpos(filter_order, x))) AS gone
  FROM f, orders
),
s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, count(*) FILTER (fails = '' OR gone > step) AS kept,
         count(*) FILTER (fails <> '' AND gone = step) AS removed,
         count(*) FILTER (fails <> '' AND gone < step AND contains(fails, substr(filter_order, step, 1))) AS redundant,
         count(*) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
         count(*) FILTER (fails <> '' AND gone = step AND good) AS good_lost, count(*) FILTER (fails <> '' AND gone = step AND toxic) AS toxic_lost
  FROM r, (SELECT unnest(range(1, 6))::INTEGER AS step) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM s
""")
def op13_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return interaction.audit(interaction.failures(table(spark, sf, "documents"), table(spark, sf, "labels")))
