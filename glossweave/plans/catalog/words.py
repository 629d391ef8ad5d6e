"""Pairs of words: sound, layered scores, cognate sets, lexical differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import phonetic, scores
from glossweave.functions.vectors import cosine
from glossweave.operators import clusters, entries as ops, pairs
from glossweave.plans import difference, views
from glossweave.plans.catalog.base import (
    FORMS, LEXICON, SQL, TREE, WORD_CUT, chance_sql, concept_table, cosine_sql, distance_sql, lexicon, phonetic_sql, query,
    r6, word_forms,
)
from glossweave.session import materialize

CUT = 0.6

@query("phonetic_pairs", f"WITH {FORMS} SELECT form_a, form_b, round(similarity, 6) AS similarity FROM near")
def phonetic_pairs(spark, sf):
    out = pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT)
    return out.select("form_a", "form_b", r6("similarity"))


@query("phonetic_matrix", f"""
WITH {FORMS}, used AS (SELECT form_a AS f FROM near UNION SELECT form_b FROM near)
SELECT form_a AS a, form_b AS b, round(similarity, 6) AS similarity FROM near
UNION ALL SELECT form_b, form_a, round(similarity, 6) FROM near UNION ALL SELECT f, f, 1e0 FROM used""")
def phonetic_matrix(spark, sf):
    near = materialize(pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT), "near").toDF("a", "b", "similarity")
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")
    used = near.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    out = near.unionByName(back).unionByName(used.select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity")))
    return out.select("a", "b", r6("similarity"))


@query("vocabulary_pairs", f"""
WITH {FORMS} SELECT a.lang AS language, form_a, form_b, round(similarity, 6) AS similarity
FROM near JOIN word_forms a ON a.f = form_a JOIN word_forms b ON b.f = form_b AND b.lang = a.lang""")
def vocabulary_pairs(spark, sf):
    """Similar words within each language."""
    out = pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT, ("language",))
    return out.select("language", "form_a", "form_b", r6("similarity"))


@query("common_sequence", f"""
WITH RECURSIVE {FORMS}, p AS (
  SELECT form_a, form_b, string_split(form_a, '') AS a, string_split(form_b, '') AS b FROM near),
dp AS (
  SELECT form_a, form_b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS row FROM p
  UNION ALL
  SELECT d.form_a, d.form_b, d.i + 1, list_concat([0], list_transform(range(1, len(p.b) + 1), lambda j:
    list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN p.b[k] = p.a[d.i + 1] THEN d.row[k] + 1 ELSE d.row[k + 1] END))))
  FROM dp d JOIN p ON p.form_a = d.form_a AND p.form_b = d.form_b WHERE d.i < len(p.a))
SELECT dp.form_a, dp.form_b, round(dp.row[len(p.b) + 1]::DOUBLE / greatest(len(p.a), len(p.b)), 6) AS ratio
FROM dp JOIN p ON p.form_a = dp.form_a AND p.form_b = dp.form_b WHERE dp.i = len(p.a)""")
def common_sequence(spark, sf):
    near = pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT)
    return near.select("form_a", "form_b", F.round(phonetic.common_ratio(F.col("form_a"), F.col("form_b")), 6).alias("ratio"))


@query("alignments")
def alignments(spark, sf):
    near = pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT)
    a = near.select("form_a", "form_b", phonetic.align(F.col("form_a"), F.col("form_b")).alias("al"))
    join = lambda c: F.array_join(f"al.{c}", " ").alias(c)
    return a.select("form_a", "form_b", join("aligned_a"), join("aligned_b"), join("ops"), "al.cost")


@query("sound_correspondences")
def sound_correspondences(spark, sf):
    near = pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT)
    return pairs.correspondence_counts(near, "form_a", "form_b").orderBy(F.desc("n"), "sound_a", "sound_b")


@query("feature_distance")
def feature_distance(spark, sf):
    """Weighted edit distance with the bits of a letter's code as its features."""
    near = materialize(pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT), "near")
    # One row per letter in use, however many words there are.
    letters = near.select(F.explode(F.split(F.concat("form_a", "form_b"), "")).alias("g")).distinct()
    table_ = {r.g: [(ord(r.g) >> k) & 1 for k in range(24)] for r in letters.collect() if len(r.g) == 1}
    d = phonetic.feature_distance(F.col("form_a"), F.col("form_b"), table_)
    return near.select("form_a", "form_b", F.round(d, 6).alias("distance"))


_PAIRS = f"""{LEXICON}, {TREE},
pairs AS (
  SELECT a.concept_id, a.id AS id_a, b.id AS id_b, a.language AS la, b.language AS lb, a.headword AS ha, b.headword AS hb,
         {phonetic_sql('a.ipa', 'b.ipa')} AS p, {cosine_sql('a.embedding', 'b.embedding')} AS s,
         {distance_sql('a.language', 'b.language', 'ta', 'tb')} AS d
  FROM lexicon a JOIN lexicon b ON a.concept_id = b.concept_id AND a.id < b.id
  LEFT JOIN tree ta ON ta.code = a.language LEFT JOIN tree tb ON tb.code = b.language)"""

_ORIGIN = f"({chance_sql('d')} * ((s + p) / 2) + (1 - (s + p) / 2) * 0.1e0)"


def _layered(mode):
    s, p, e = scores.WEIGHTS[mode]
    return f"({s}e0 * s + {p}e0 * p + {e}e0 * {_ORIGIN})"


def _register_layered(mode):
    @query(f"layered_scores_{mode}", f"""
WITH {_PAIRS}
SELECT id_a, id_b, round(s, 6) AS semantic, round(p, 6) AS phonetic, round({_ORIGIN}, 6) AS etymological,
       round({_layered(mode)}, 6) AS combined, d AS tree_distance FROM pairs WHERE p >= {CUT}""")
    def run(spark, sf):
        met = pairs.entry_pairs(lexicon(spark, sf), CUT)
        out = pairs.layered_scores(met, mode)
        return out.select(
            F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), r6("semantic"), r6("phonetic"),
            r6("etymological"), r6("combined"), "tree_distance",
        )


for _mode in scores.WEIGHTS:
    _register_layered(_mode)


@query("similarity_edges", f"""
WITH {_PAIRS}
SELECT id_a AS entry_a, id_b AS entry_b, round(p, 6) AS phonetic_score, round(s, 6) AS semantic_score,
       round(0.6e0 * p + 0.4e0 * s, 6) AS combined_score FROM pairs WHERE p >= {CUT}""")
def similarity_edges(spark, sf):
    edges = pairs.similarity_edges(pairs.entry_pairs(lexicon(spark, sf), CUT))
    return edges.select("entry_a", "entry_b", r6("phonetic_score"), r6("semantic_score"), r6("combined_score"))


def layered_edges(words):
    out = pairs.layered_scores(pairs.entry_pairs(words, CUT), "balanced")
    return out.select(
        F.col("a.id").alias("entry_a"), F.col("b.id").alias("entry_b"), F.col("semantic").alias("semantic_score"),
        F.col("phonetic").alias("phonetic_score"), F.col("etymological").alias("etymological_score"),
        F.col("combined").alias("combined_score"), F.col("tree_distance").alias("phylogenetic_distance"),
    )


@query("find_similar", f"""
WITH {_PAIRS}, e AS (SELECT id_a, id_b, {_layered('balanced')} AS c FROM pairs WHERE p >= {CUT}),
busy AS (SELECT id FROM (SELECT id_a AS id FROM e UNION ALL SELECT id_b FROM e) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1),
mine AS (SELECT CASE WHEN id_a = id THEN id_b ELSE id_a END AS entry_id, c FROM e, busy WHERE id IN (id_a, id_b))
SELECT entry_id, headword, language, round(c, 6) AS combined_score FROM mine JOIN lexicon ON lexicon.id = entry_id
ORDER BY c DESC, entry_id LIMIT 10""")
def find_similar(spark, sf):
    words = lexicon(spark, sf)
    edges = materialize(layered_edges(words), "edges")
    ends = edges.select(F.explode(F.array("entry_a", "entry_b")).alias("id")).groupBy("id").count()
    busiest = ends.orderBy(F.desc("count"), "id").first()[0]
    return ops.similar_entries(edges, words, busiest, 10).select("entry_id", "headword", "language", r6("combined_score"))


def _quality_sql(e: str) -> str:
    return (
        f"round(greatest(0e0, 1e0 - CASE WHEN {e}.etymology IS NULL THEN 0.1e0 ELSE 0e0 END - CASE WHEN {e}.pos_tag IS NULL THEN 0.1e0 "
        f"ELSE 0e0 END - CASE WHEN length({e}.definition) < 10 THEN 0.2e0 ELSE 0e0 END), 6)"
    )


@query("sql_functions", f"""
WITH {_PAIRS}, e AS (SELECT id_a, id_b, {_layered('balanced')} AS c, {_layered('cognate')} AS k FROM pairs WHERE p >= {CUT}),
busy AS (SELECT id FROM (SELECT id_a AS id FROM e UNION ALL SELECT id_b FROM e) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)
SELECT id_a::VARCHAR AS entry_a, id_b::VARCHAR AS entry_b, round(k, 6) AS cognate, {_quality_sql('a')} AS quality_a, {_quality_sql('b')} AS quality_b,
       CASE WHEN busy.id IN (id_a, id_b) THEN round(c, 6) END AS found_score
FROM e JOIN lexicon a ON a.id = id_a JOIN lexicon b ON b.id = id_b, busy""")
def sql_functions(spark, sf):
    """The three SQL functions of the dictionary in one statement, over all edges."""
    text = F.col("id").cast("string").alias("id")
    words = lexicon(spark, sf)
    edges = materialize(layered_edges(words), "edges")
    ends = edges.select(F.explode(F.array("entry_a", "entry_b")).alias("id")).groupBy("id").count()
    busiest = ends.orderBy(F.desc("count"), "id").first()
    named = words.select(text, *[c for c in words.columns if c != "id"]).withColumns({
        "data_quality": F.lit(None).cast("double"), "validation_errors": F.lit(None).cast("array<string>"),
        "updated_at": F.lit(None).cast("timestamp"),
    })
    sources = words.select(F.col("source_id").alias("id"), F.col("source_id").alias("name"), F.lit(None).cast("string").alias("quality")).distinct()
    concepts = concept_table(spark, sf).withColumn("confidence", F.lit(None).cast("double"))
    cast = {c: F.col(c).cast("string") for c in ("entry_a", "entry_b")}
    views.register(spark, sources, named, concepts, edges.withColumns(cast))
    weights = ", ".join(f"'{n}', {v}D" for n, v in zip(("semantic", "phonetic", "etymological"), scores.WEIGHTS["cognate"]))
    target = "" if busiest is None else busiest.id
    return spark.sql(f"""
SELECT l.entry_a, l.entry_b,
       round(compute_layered_similarity(l.semantic_score, l.phonetic_score, l.etymological_score, map({weights})), 6) AS cognate,
       round(compute_entry_quality(a.etymology, a.pos_tag, a.embedding IS NOT NULL, 0, a.definition), 6) AS quality_a,
       round(compute_entry_quality(b.etymology, b.pos_tag, b.embedding IS NOT NULL, 0, b.definition), 6) AS quality_b,
       round(s.combined_score, 6) AS found_score
FROM layered_similarities l JOIN entries a ON a.id = l.entry_a JOIN entries b ON b.id = l.entry_b
LEFT JOIN find_similar_entries('{target}', 1000000000) s
  ON '{target}' IN (l.entry_a, l.entry_b) AND s.entry_id = if(l.entry_a = '{target}', l.entry_b, l.entry_a)""")


_DIFFERENCES = f"""{_PAIRS}, diff AS (
  SELECT concept_id, upper(concept_id) AS concept_label, least(la, lb) AS language_a, greatest(la, lb) AS language_b,
         CASE WHEN la < lb THEN ha ELSE hb END AS form_a, CASE WHEN la < lb THEN hb ELSE ha END AS form_b,
         round({_layered('balanced')}, 6) AS combined_score, d AS phylogenetic_distance
  FROM pairs WHERE p >= {CUT} AND la <> lb)"""


@query("lexical_differences", f"WITH {_DIFFERENCES} SELECT * FROM diff")
def lexical_differences(spark, sf):
    words = lexicon(spark, sf)
    out = ops.lexical_differences(layered_edges(words), words, concept_table(spark, sf))
    return out.select(
        "concept_id", "concept_label", "language_a", "language_b", "form_a", "form_b", r6("combined_score"),
        "phylogenetic_distance",
    )


@query("unscored_pairs", f"""
WITH {_DIFFERENCES},
n AS (SELECT concept_id, language, count(*) AS n FROM lexicon GROUP BY ALL),
s AS (SELECT concept_id, language_a, language_b, count(*) AS scored FROM diff GROUP BY ALL)
SELECT a.concept_id, a.language AS language_a, b.language AS language_b, a.n * b.n AS pairs,
       coalesce(scored, 0) AS scored, a.n * b.n - coalesce(scored, 0) AS unscored
FROM n a JOIN n b ON a.concept_id = b.concept_id AND a.language < b.language
LEFT JOIN s ON s.concept_id = a.concept_id AND s.language_a = a.language AND s.language_b = b.language""")
def unscored_pairs(spark, sf):
    words = lexicon(spark, sf)
    diff = ops.lexical_differences(layered_edges(words), words, concept_table(spark, sf))
    return ops.unscored_pairs(words, diff)


@query("meaning_pairs", f"WITH {_PAIRS} SELECT id_a, id_b, round(s, 6) AS semantic, round(p, 6) AS phonetic FROM pairs WHERE s >= 0.2e0")
def meaning_pairs(spark, sf):
    """Pairs of entries of a concept by meaning alone."""
    out = pairs.meaning_pairs(lexicon(spark, sf), 0.2)
    meaning = cosine(F.col("a.embedding"), F.col("b.embedding"))
    return out.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(meaning, 6).alias("semantic"), r6("phonetic"))


def _register_scored(mode, cut):
    @query(f"scored_pairs_{mode}", f"""
WITH {_PAIRS} SELECT id_a, id_b, round(s, 6) AS semantic, round(p, 6) AS phonetic, round({_layered(mode)}, 6) AS combined
FROM pairs WHERE {_layered(mode)} >= {cut}e0""")
    def run(spark, sf):
        out = pairs.scored_pairs(lexicon(spark, sf), mode, cut)
        return out.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), r6("semantic"), r6("phonetic"), r6("combined"))


for _mode, _cut in (("semantic", 0.25), ("historical", 0.3)):
    _register_scored(_mode, _cut)


def _clusters_sql(score: str, cut: float) -> str:
    """Star clusters by walking the entries of each concept in id order."""
    return f"""
adj AS (SELECT id_b AS id, list(id_a) AS earlier FROM pairs WHERE {score} >= {cut}e0 GROUP BY id_b),
ranked AS (SELECT concept_id, l.id, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY concept_id ORDER BY l.id) AS k
           FROM lexicon l LEFT JOIN adj ON adj.id = l.id),
walk AS (
  SELECT concept_id, k, [id] AS leaders FROM ranked WHERE k = 1
  UNION ALL
  SELECT w.concept_id, r.k, CASE WHEN list_has_any(w.leaders, r.earlier) THEN w.leaders ELSE list_append(w.leaders, r.id) END
  FROM walk w JOIN ranked r ON r.concept_id = w.concept_id AND r.k = w.k + 1),
final AS (SELECT concept_id, arg_max(leaders, k) AS leaders FROM walk GROUP BY concept_id),
clusters AS (
  SELECT r.concept_id, r.id, CASE WHEN list_contains(f.leaders, r.id) THEN r.id
         ELSE list_min(list_intersect(r.earlier, f.leaders)) END AS leader
  FROM ranked r JOIN final f USING (concept_id))"""


@query("cognate_clusters", f"WITH RECURSIVE {_PAIRS}, {_clusters_sql(_layered('cognate'), 0.6)} SELECT concept_id, id, leader FROM clusters")
def cognate_clusters(spark, sf):
    return difference.cognate_clusters(lexicon(spark, sf)).select("concept_id", "id", "leader")


_TWO = "(0.6e0 * p + 0.4e0 * s)"


@query("cognate_sets", f"""
WITH RECURSIVE {_PAIRS}, {_clusters_sql(_TWO, 0.7)},
inside AS (SELECT a.leader, avg({_TWO}) AS m FROM pairs JOIN clusters a ON a.id = id_a JOIN clusters b ON b.id = id_b
           WHERE a.leader = b.leader AND p >= 0.5 GROUP BY a.leader)
SELECT 'cognate_set_' || c.leader AS id, count(*) AS size,
       round(CASE WHEN count(*) < 2 THEN 1e0 ELSE coalesce(max(m), 0e0) END, 6) AS confidence, md5(max(l.definition)) AS core_md5
FROM clusters c JOIN lexicon l ON l.id = c.leader LEFT JOIN inside i ON i.leader = c.leader GROUP BY c.leader""")
def cognate_sets(spark, sf):
    words = lexicon(spark, sf)
    edges = materialize(pairs.similarity_edges(pairs.entry_pairs(words, 0.5)), "edges")
    strong = edges.filter("combined_score >= 0.7").select(F.col("entry_a").alias("a"), F.col("entry_b").alias("b"))
    members = clusters.greedy_leaders(words.filter("concept_id is not null"), strong)
    sets = clusters.cognate_sets(members, words, edges)
    return sets.select("id", "size", r6("confidence"), F.md5("semantic_core").alias("core_md5"))


@query("lexical_difference_report", f"""
WITH RECURSIVE {_PAIRS}, {_clusters_sql(_layered('cognate'), 0.6)},
firsts AS (SELECT l.*, c.leader FROM lexicon l JOIN clusters c ON c.id = l.id
           QUALIFY row_number() OVER (PARTITION BY l.concept_id, language ORDER BY l.id) = 1),
mates AS (SELECT f.id AS fid, l.language, min(l.id) AS seen, arg_max(l.headword, l.id) AS any_head
          FROM firsts f JOIN clusters c ON c.leader = f.leader AND c.id <> f.id JOIN lexicon l ON l.id = c.id GROUP BY ALL),
listed AS (SELECT fid, list(language ORDER BY seen) AS langs, string_agg(language || '=' || any_head, ',' ORDER BY language) AS shown FROM mates GROUP BY fid),
told AS (
  SELECT a.concept_id, a.language AS la, b.language AS lb, a.headword AS ha, b.headword AS hb, a.leader AS ca, b.leader AS cb,
         coalesce(x.langs, []) AS xa, coalesce(y.langs, []) AS xb, coalesce(x.shown, '') AS sa, coalesce(y.shown, '') AS sb,
         ta.branch AS ba, tb.branch AS bb, {phonetic_sql('a.ipa', 'b.ipa')} AS p, {cosine_sql('a.embedding', 'b.embedding')} AS s,
         {distance_sql('a.language', 'b.language', 'ta', 'tb')} AS d
  FROM firsts a JOIN firsts b ON a.concept_id = b.concept_id AND a.language < b.language
  LEFT JOIN listed x ON x.fid = a.id LEFT JOIN listed y ON y.fid = b.id
  LEFT JOIN tree ta ON ta.code = a.language LEFT JOIN tree tb ON tb.code = b.language)
SELECT concept_id, la AS language_a, lb AS language_b, ha AS form_a, hb AS form_b, 'cluster_' || ca AS cluster_a, 'cluster_' || cb AS cluster_b,
  sa AS cognates_a, sb AS cognates_b, d AS tree_distance, round({_layered('cognate')}, 6) AS combined,
  concat_ws(' ', upper(la) || ' uses ''' || ha || ''' while ' || upper(lb) || ' uses ''' || hb || ''' for the same concept.',
    CASE WHEN p > 0.7 THEN 'These forms show high phonetic similarity (' || printf('%.2f', p) || '), suggesting possible cognate relationship.'
         WHEN p < 0.3 THEN 'These forms are phonetically distinct (' || printf('%.2f', p) || '), indicating likely separate origins.' END,
    CASE WHEN ca <> cb AND len(xa) > 0 THEN '''' || ha || ''' clusters with forms in: ' || array_to_string(xa[1:3], ', ') || '.' END,
    CASE WHEN ca <> cb AND len(xb) > 0 THEN '''' || hb || ''' clusters with forms in: ' || array_to_string(xb[1:3], ', ') || '.' END,
    CASE WHEN d <= 2 THEN 'Despite close phylogenetic relationship (distance=' || d || '), these languages diverged lexically for this concept.'
         WHEN d >= 5 THEN 'This difference aligns with distant phylogenetic relationship (distance=' || d || ').' END,
    CASE WHEN ba <> bb THEN 'This reflects the split between ' || ba || ' and ' || bb || ' branches.'
         ELSE 'This variation exists within the ' || ba || ' branch, possibly due to substrate influence, borrowing, or lexical replacement.' END
  ) AS explanation
FROM told""")
def lexical_difference_report(spark, sf):
    out = difference.lexical_differences(lexicon(spark, sf))
    shown = lambda c: F.array_join(
        F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","
    ).alias(c)
    return out.select(
        "concept_id", "language_a", "language_b", "form_a", "form_b", "cluster_a", "cluster_b",
        shown("cognates_a"), shown("cognates_b"), "tree_distance", r6("combined"), "explanation",
    )


@query("cluster_rows", f"""
WITH RECURSIVE {_PAIRS}, {_clusters_sql(_layered('cognate'), 0.6)},
inside AS (SELECT a.leader, avg({_layered('cognate')}) AS m FROM pairs JOIN clusters a ON a.id = id_a JOIN clusters b ON b.id = id_b
           WHERE a.leader = b.leader AND p >= 0.5 GROUP BY a.leader)
SELECT c.concept_id, c.leader, max(l.headword) FILTER (l.id = c.leader) AS representative_form,
  string_agg(DISTINCT l.language, ',' ORDER BY l.language) AS languages, count(*) AS size,
  round(CASE WHEN count(*) < 2 THEN 1e0 ELSE coalesce(max(m), 0e0) END, 6) AS confidence
FROM clusters c JOIN lexicon l ON l.id = c.id LEFT JOIN inside i ON i.leader = c.leader GROUP BY ALL""")
def cluster_rows(spark, sf):
    words = lexicon(spark, sf)
    members = materialize(difference.cognate_clusters(words), "members")
    scored = pairs.layered_scores(pairs.entry_pairs(words, 0.5), "cognate").select(
        F.col("a.id").alias("entry_a"), F.col("b.id").alias("entry_b"), F.col("combined").alias("combined_score")
    )
    sets = clusters.set_confidence(scored, members.select("id", F.col("leader").alias("set_id")))
    out = clusters.cluster_rows(members, words, sets)
    return out.select(
        "concept_id", "leader", "representative_form", F.array_join("languages", ",").alias("languages"), "size", r6("confidence")
    )


_DP = f"""{FORMS}, p AS (SELECT form_a, form_b, string_split(form_a, '') AS a, string_split(form_b, '') AS b FROM near),
dp AS (
  SELECT form_a, form_b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: FIRST) AS row FROM p
  UNION ALL
  SELECT d.form_a, d.form_b, d.i + 1, STEP FROM dp d JOIN p ON p.form_a = d.form_a AND p.form_b = d.form_b WHERE d.i < len(p.a))"""

_WARP = _DP.replace("FIRST", "CASE WHEN j = 0 THEN 0e0 ELSE 1e9 END").replace("STEP", """list_concat([1e9], list_transform(range(1, len(p.b) + 1), lambda j:
    list_min(list_transform(range(1, j + 1), lambda k: least(d.row[k], d.row[k + 1])
      + list_sum(list_transform(range(k, j + 1), lambda l: CASE WHEN p.b[l] = p.a[d.i + 1] THEN 0e0 ELSE 1e0 END))))))""")


@query("warp_cost", f"""
WITH RECURSIVE {_WARP}
SELECT dp.form_a, dp.form_b, dp.row[len(p.b) + 1] AS cost FROM dp JOIN p ON p.form_a = dp.form_a AND p.form_b = dp.form_b WHERE dp.i = len(p.a)""")
def warp_cost(spark, sf):
    near = pairs.similar_forms(word_forms(spark, sf), "ipa", WORD_CUT)
    return near.select("form_a", "form_b", phonetic.align(F.col("form_a"), F.col("form_b"))["cost"].alias("cost"))


_FEATURE = _DP.replace("FIRST", "j::DOUBLE").replace("STEP", """list_concat([d.i + 1e0], list_transform(range(1, len(p.b) + 1), lambda j:
    least(d.i + 1e0 + j, list_min(list_transform(range(1, j + 1), lambda k: least(d.row[k + 1] + 1e0,
      d.row[k] + bit_count(xor(unicode(p.b[k]), unicode(p.a[d.i + 1]))) / 24e0) + (j - k))))))""")

SQL["feature_distance"] = f"""
WITH RECURSIVE {_FEATURE}
SELECT dp.form_a, dp.form_b, round(dp.row[len(p.b) + 1] / greatest(len(p.a), len(p.b)), 6) AS distance
FROM dp JOIN p ON p.form_a = dp.form_a AND p.form_b = dp.form_b WHERE dp.i = len(p.a)"""
