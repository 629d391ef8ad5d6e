"""Language tree, coverage, and trees of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions import scores, tree
from glossweave.operators import concepts, entries as ops, trees
from glossweave.plans.catalog.base import ENTRIES, TREE, chance_sql, distance_sql, query, r6, table, vector_entries
from glossweave.session import materialize
from glossweave.sources.catalog import EXPECTED_FILES

# Each nation speaks one language of the tree, evenly spread over all families.
_ROWS = tree.language_rows()
_NATIONS = {n: _ROWS[n * len(_ROWS) // 25][0] for n in range(25)}

_TRADE = f"""{TREE}, spoken AS (SELECT n_nationkey AS k, code, depth, family, branch, path FROM nation JOIN tree ON tree.n = n_nationkey * {len(_ROWS)} // 25),
trade AS (
  SELECT a.code AS language_a, b.code AS language_b, a.path AS pa, b.path AS pb, {distance_sql('a.code', 'b.code', 'a', 'b')} AS tree_distance,
         a.family AS family_a, b.family AS family_b, count(*) AS items, sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN spoken a ON a.k = c_nationkey JOIN spoken b ON b.k = s_nationkey GROUP BY ALL)"""


def _trade(spark, sf):
    """Traded items per pair of customer and supplier language."""
    codes = F.create_map(*[F.lit(x) for pair in _NATIONS.items() for x in pair])
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    met = items.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    # Reduced to nation pairs before the tree comes in.
    per = met.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("items"), F.sum("l_quantity").alias("quantity"))
    return per.select(codes[F.col("c_nationkey")].alias("language_a"), codes[F.col("s_nationkey")].alias("language_b"), "items", "quantity")


@query("tree_distance", f"""
WITH {_TRADE} SELECT language_a, language_b, family_a, family_b, tree_distance, {chance_sql('tree_distance')} AS prior, items,
  round(quantity, 2) AS quantity FROM trade""")
def tree_distance(spark, sf):
    out = tree.add_tree_distance(_trade(spark, sf), "language_a", "language_b", keep=True)
    return out.select(
        "language_a", "language_b", F.col("a_family").alias("family_a"), F.col("b_family").alias("family_b"),
        "tree_distance", scores.origin_chance(F.col("tree_distance")).alias("prior"), "items",
        F.round("quantity", 2).alias("quantity"),
    )


@query("tree_distance_lca", f"""
WITH {_TRADE}, e AS (
  SELECT *, len(string_split(pa, '/')) + len(string_split(pb, '/')) - 2 * len(list_intersect(string_split(pa, '/'), string_split(pb, '/'))) AS edges FROM trade)
SELECT language_a, language_b, CASE WHEN language_a = language_b THEN 0 WHEN family_a <> family_b THEN 15 ELSE greatest(edges, 1) END::INT AS edges, items FROM e""")
def tree_distance_lca(spark, sf):
    out = tree.add_tree_distance(_trade(spark, sf), "language_a", "language_b", "edges", "lca")
    return out.select("language_a", "language_b", "edges", "items")


@query("family_trade", f"""
WITH {_TRADE} SELECT family_a, family_b, sum(items)::BIGINT AS items, count(*) AS pairs FROM trade GROUP BY ALL""")
def family_trade(spark, sf):
    out = tree.add_tree_distance(_trade(spark, sf), "language_a", "language_b", keep=True)
    return out.groupBy(F.col("a_family").alias("family_a"), F.col("b_family").alias("family_b")).agg(
        F.sum("items").alias("items"), F.count(F.lit(1)).alias("pairs")
    )


_EXPECTED = "expected AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', " + (f"'{f}'" if f else "NULL") + ")" for c, f in EXPECTED_FILES.items()
) + ") x(iso_code, file))"

_COVERED = f"""{TREE}, {_EXPECTED},
present AS (SELECT DISTINCT file FROM documents JOIN expected ON iso_code = lang),
covered AS (SELECT code AS iso_code, family, e.file, CASE WHEN e.file IS NULL THEN 'ALTERNATIVE' WHEN p.file IS NOT NULL THEN 'COMPLETE' ELSE 'MISSING' END AS status
  FROM tree LEFT JOIN expected e ON e.iso_code = code LEFT JOIN present p ON p.file = e.file)"""


def _files(spark, sf):
    expected = spark.createDataFrame(list(EXPECTED_FILES.items()), "iso_code string, file string")
    found = table(spark, sf, "documents").select(F.col("lang").alias("iso_code")).distinct()
    return expected, found.join(F.broadcast(expected), "iso_code").select("file")


@query("coverage", f"WITH {_COVERED} SELECT iso_code, family, file, status FROM covered")
def coverage(spark, sf):
    expected, present = _files(spark, sf)
    return ops.coverage(tree.languages(spark), expected, present).select("iso_code", "family", "file", "status")


@query("coverage_summary", f"""
WITH {_COVERED} SELECT family, count(*) AS total, count(*) FILTER (status <> 'MISSING') AS with_data,
  round(100e0 * count(*) FILTER (status <> 'MISSING') / count(*), 1) AS percent,
  coalesce(string_agg(iso_code, ',' ORDER BY iso_code) FILTER (status = 'MISSING'), '') AS missing
FROM covered GROUP BY ROLLUP (family)""")
def coverage_summary(spark, sf):
    expected, present = _files(spark, sf)
    out = ops.coverage_summary(ops.coverage(tree.languages(spark), expected, present))
    return out.withColumn("missing", F.array_join("missing", ","))


@query("unmapped_files", f"""
WITH {_EXPECTED} SELECT DISTINCT lower(n_name) AS file FROM nation JOIN customer ON c_nationkey = n_nationkey
WHERE lower(n_name) NOT IN (SELECT file FROM expected WHERE file IS NOT NULL)""")
def unmapped_files(spark, sf):
    expected, _ = _files(spark, sf)
    named = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return ops.unmapped_files(named.select(F.lower("n_name").alias("file")), expected)


def _source_matrix(spark, sf):
    """Distances between sources, one matrix per concept."""
    e = vector_entries(spark, sf).select("id", "embedding", "concept_id", "source_id")
    return trees.distances(concepts.language_similarity(e, "source_id", "concept_id"))


_UNIT = "list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding)))"


@query("distance_matrix", f"""
WITH {ENTRIES}, u AS (SELECT concept_id, source_id, {_UNIT} AS e FROM entries WHERE embedding IS NOT NULL),
s AS (SELECT a.concept_id AS grp, a.source_id AS a, b.source_id AS b, 1 - avg(list_dot_product(a.e, b.e)) AS d
      FROM u a JOIN u b ON a.concept_id = b.concept_id AND a.source_id <> b.source_id GROUP BY ALL),
t AS (SELECT DISTINCT grp, a FROM s)
SELECT grp, a, b, round(d, 6) AS d FROM s UNION ALL SELECT grp, a, a, 0e0 FROM t""")
def distance_matrix(spark, sf):
    return _source_matrix(spark, sf).select("grp", "a", "b", r6("d"))


@query("dendrograms")
def dendrograms(spark, sf):
    out = trees.dendrograms(_source_matrix(spark, sf), "ward.D2")
    return out.select("grp", "step", F.array_join("left", ",").alias("left"), F.array_join("right", ",").alias("right"), r6("height"))


@query("cluster_number_range", f"""
WITH {ENTRIES}, n AS (SELECT concept_id AS grp, count(DISTINCT source_id) AS taxa FROM entries WHERE concept_id IS NOT NULL GROUP BY concept_id)
SELECT grp, 2 AS k_low, least(10, taxa - 1)::INT AS k_high FROM n""")
def cluster_number_range(spark, sf):
    return trees.group_counts(trees.dendrograms(_source_matrix(spark, sf), "average"))


@query("source_trees")
def source_trees(spark, sf):
    out = trees.infer_trees(_source_matrix(spark, sf), "nj")
    return out.select("grp", F.array_join("clade", ",").alias("clade"), r6("length"))


@query("tree_fit")
def tree_fit(spark, sf):
    matrix = materialize(_source_matrix(spark, sf), "matrix")
    out = trees.tree_fit(trees.infer_trees(matrix, "upgma"), matrix)
    return out.select("grp", r6("correlation"), "interpretation")


@query("compare_trees")
def compare_trees(spark, sf):
    matrix = materialize(_source_matrix(spark, sf), "matrix")
    taxa = matrix.select("grp", F.col("a").alias("taxon")).distinct()
    out = trees.compare_trees(trees.infer_trees(matrix, "nj"), trees.infer_trees(matrix, "upgma"), taxa)
    return out.withColumn("normalized_rf", F.round("normalized_rf", 6))


@query("bootstrap_support")
def bootstrap_support(spark, sf):
    out = trees.bootstrap_support(_source_matrix(spark, sf), 20, "upgma")
    return out.select("grp", "split", r6("support"), "replicates")
