"""The similarity graph of all word forms of the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import clusters, graph
from glossweave.operators.pairs import similar_forms
from glossweave.plans import layout
from glossweave.plans.catalog.base import FORMS, WORD_CUT, query, r6, vector_entries, word_forms
from glossweave.session import materialize

STRONG = 0.9
CLOSE = 0.86

EDGES = f"{FORMS}, edges AS (SELECT form_a AS src, form_b AS dst, similarity AS weight FROM near)"
BOTH = f"""{EDGES},
both_ways AS MATERIALIZED (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
nodes AS (SELECT DISTINCT src AS node FROM both_ways)"""


def _reach(name: str, cut: float | None) -> str:
    where = "" if cut is None else f"WHERE weight >= {cut}"
    return f"""{name}_r(node, component) USING KEY (node) AS (SELECT node, node FROM nodes UNION
  SELECT b.dst, min(r.component) FROM {name}_r r JOIN (SELECT * FROM both_ways {where}) b ON b.src = r.node
  JOIN recurring.{name}_r o ON o.node = b.dst GROUP BY b.dst, o.component HAVING min(r.component) < o.component),
{name} AS MATERIALIZED (SELECT node, component FROM {name}_r)"""


def word_edges(spark, sf):
    """Similar word forms as graph edges, computed once and read by every round."""
    near = similar_forms(word_forms(spark, sf), "ipa", WORD_CUT)
    return materialize(near.select(F.col("form_a").alias("src"), F.col("form_b").alias("dst"), F.col("similarity").alias("weight")), "edges")


@query("strong_edges", f"WITH {EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE weight >= {STRONG}")
def strong_edges(spark, sf):
    return graph.above(word_edges(spark, sf), STRONG).select("src", "dst", r6("weight"))


@query("components", f"WITH RECURSIVE {BOTH}, {_reach('comp', None)} SELECT node, component FROM comp")
def components(spark, sf):
    return graph.components(word_edges(spark, sf))


@query("component_sizes", f"WITH RECURSIVE {BOTH}, {_reach('comp', None)} SELECT component, count(*) AS size FROM comp GROUP BY component")
def component_sizes(spark, sf):
    return graph.component_sizes(graph.components(word_edges(spark, sf)))


@query("threshold_clusters", f"WITH RECURSIVE {BOTH}, {_reach('comp', STRONG)} SELECT node, component FROM comp")
def threshold_clusters(spark, sf):
    return graph.threshold_clusters(word_edges(spark, sf), STRONG)


@query("graph_stats", f"""
WITH RECURSIVE {BOTH}, {_reach('comp', None)},
n AS (SELECT count(*) AS nodes, count(DISTINCT component) AS components FROM comp), e AS (SELECT count(*) AS edges FROM edges)
SELECT nodes, edges, round(2e0 * edges / nodes, 6) AS avg_degree, round(2e0 * edges / (nodes * (nodes - 1)), 6) AS density, components FROM n, e""")
def graph_stats(spark, sf):
    return graph.stats(word_edges(spark, sf)).select("nodes", "edges", r6("avg_degree"), r6("density"), "components")


@query("degrees", f"WITH {BOTH} SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY src")
def degrees(spark, sf):
    return graph.degrees(word_edges(spark, sf))


def _rank_steps(n: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node, 1e0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(1, n + 1):
        steps.append(f"""r{i} AS MATERIALIZED (
  SELECT n.node, 0.15e0 / (SELECT count(*) FROM nodes) + 0.85e0 * coalesce(sum(r.rank / d.degree), 0) AS rank
  FROM nodes n LEFT JOIN both_ways b ON b.dst = n.node LEFT JOIN r{i - 1} r ON r.node = b.src LEFT JOIN deg d ON d.node = b.src GROUP BY n.node)""")
    return ",\n".join(steps)


@query("pagerank", f"""
WITH {BOTH}, deg AS (SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY src), {_rank_steps(10)}
SELECT node, round(rank, 8) AS rank FROM r10""")
def pagerank(spark, sf):
    ranks = graph.pagerank(word_edges(spark, sf), 0.85, 10)
    return ranks.select("node", F.round("rank", 8).alias("rank"))


_HUB = "hub AS (SELECT src AS node FROM both_ways GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def _hub(edges):
    return graph.degrees(edges).orderBy(F.desc("degree"), "node").limit(1).select("node")


@query("shortest_paths", f"""
WITH RECURSIVE {BOTH}, {_HUB}, path(node, cost) USING KEY (node) AS (SELECT node, 0e0 FROM hub UNION
  SELECT b.dst, min(p.cost + b.weight) FROM path p JOIN both_ways b ON b.src = p.node LEFT JOIN recurring.path o ON o.node = b.dst
  GROUP BY b.dst, o.cost HAVING o.cost IS NULL OR min(p.cost + b.weight) < o.cost)
SELECT node, round(cost, 6) AS cost FROM path""")
def shortest_paths(spark, sf):
    edges = word_edges(spark, sf)
    return graph.shortest_paths(edges, _hub(edges)).select("node", r6("cost"))


@query("modularity", f"""
WITH RECURSIVE {BOTH}, {_reach('comp', STRONG)},
m AS (SELECT count(*)::DOUBLE AS m FROM edges),
deg AS (SELECT component, count(*)::DOUBLE AS degree FROM both_ways JOIN comp ON node = src GROUP BY component),
ins AS (SELECT a.component, count(*)::DOUBLE AS inside FROM edges JOIN comp a ON a.node = src JOIN comp b ON b.node = dst
        WHERE a.component = b.component GROUP BY a.component)
SELECT round(sum(coalesce(inside, 0) / m - (degree / (2 * m)) * (degree / (2 * m))), 6) AS modularity
FROM deg LEFT JOIN ins USING (component), m""")
def modularity(spark, sf):
    edges = word_edges(spark, sf)
    groups = _members(edges).toDF("node", "community")
    return graph.modularity(edges, groups).select(r6("modularity"))


@query("communities")
def communities(spark, sf):
    return graph.communities(word_edges(spark, sf))


@query("sparse_cells", f"""
WITH {BOTH} SELECT src AS i, dst AS j, round(weight, 6) AS value FROM both_ways WHERE weight >= {STRONG}
UNION ALL SELECT node, node, 1e0 FROM nodes""")
def sparse_cells(spark, sf):
    return graph.sparse_entries(word_edges(spark, sf), STRONG).select("i", "j", r6("value"))


@query("sparse_facts", f"""
WITH {BOTH}, n AS (SELECT count(*) AS n FROM nodes), z AS (SELECT count(*) AS c FROM both_ways WHERE weight >= {STRONG})
SELECT n, c + n AS nnz, round(1e0 - (c + n)::DOUBLE / (n::DOUBLE * n), 6) AS sparsity FROM n, z""")
def sparse_facts(spark, sf):
    return graph.sparse_facts(word_edges(spark, sf), STRONG).select("n", "nnz", r6("sparsity"))


@query("matvec", f"""
WITH {BOTH}, cells AS (SELECT src AS i, dst AS j, weight AS value FROM both_ways UNION ALL SELECT node, node, 1e0 FROM nodes)
SELECT i AS node, round(sum(value * length(j)), 6) AS y FROM cells GROUP BY i""")
def matvec(spark, sf):
    edges = word_edges(spark, sf)
    vector = graph.nodes_of(edges).withColumn("x", F.length("node").cast("double"))
    return graph.matvec(graph.sparse_entries(edges, 0.0), vector).select("node", r6("y"))


_CHOSEN = f"chosen AS (SELECT f AS node FROM word_forms WHERE lang = 'de')"


@query("submatrix", f"""
WITH {BOTH}, {_CHOSEN}, cells AS (SELECT src AS i, dst AS j, weight AS value FROM both_ways UNION ALL SELECT node, node, 1e0 FROM nodes)
SELECT i, j, round(value, 6) AS value FROM cells WHERE i IN (FROM chosen) AND j IN (FROM chosen)""")
def submatrix(spark, sf):
    chosen = word_forms(spark, sf).filter("language = 'de'").select(F.col("ipa").alias("node"))
    return graph.submatrix(graph.sparse_entries(word_edges(spark, sf), 0.0), chosen).select("i", "j", r6("value"))


@query("dense_rows", f"""
WITH {BOTH}, top AS (SELECT src AS node FROM both_ways GROUP BY src ORDER BY count(*) DESC, src LIMIT 8),
grid AS (SELECT a.node AS i, b.node AS j FROM top a, top b)
SELECT i, string_agg(printf('%.4f', CASE WHEN i = j THEN 1e0 ELSE coalesce(weight, 0e0) END), ' ' ORDER BY j) AS cells
FROM grid LEFT JOIN both_ways ON src = i AND dst = j GROUP BY i""")
def dense_rows(spark, sf):
    edges = word_edges(spark, sf)
    top = [r.node for r in graph.degrees(edges).orderBy(F.desc("degree"), "node").limit(8).collect()]
    rows = graph.dense_rows(graph.sparse_entries(edges, 0.0), sorted(top))
    return rows.select("i", F.array_join(F.transform("values", lambda v: F.format_string("%.4f", v)), " ").alias("cells"))


@query("nearest_words", f"""
WITH {BOTH} SELECT src, dst, round(weight, 6) AS weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst DESC)::INT AS rank
FROM both_ways QUALIFY rank <= 3""")
def nearest_words(spark, sf):
    return graph.nearest(word_edges(spark, sf), 3).select("src", "dst", r6("weight"), "rank")


@query("neighbours", f"""
WITH {BOTH}, {_HUB} SELECT dst AS neighbour, round(weight, 6) AS weight FROM both_ways JOIN hub ON node = src WHERE weight >= {CLOSE}""")
def neighbours(spark, sf):
    edges = word_edges(spark, sf)
    return graph.neighbours(edges, _hub(edges).first()[0], CLOSE).select("neighbour", r6("weight"))


def _members(edges):
    return materialize(graph.threshold_clusters(edges, STRONG), "members").toDF("id", "cluster")


@query("silhouette", f"""
WITH RECURSIVE {BOTH}, {_reach('comp', STRONG)}, size AS (SELECT component, count(*) AS n FROM comp GROUP BY component),
per AS (SELECT a.node, a.component AS own, b.component AS other, avg(1 - weight) AS d FROM both_ways JOIN comp a ON a.node = src
        JOIN comp b ON b.node = dst GROUP BY ALL),
ab AS (SELECT c.node, max(n) AS n, coalesce(max(d) FILTER (own = other), 0) AS a, coalesce(min(d) FILTER (own <> other), 'inf'::DOUBLE) AS b
       FROM comp c JOIN size USING (component) LEFT JOIN per USING (node) GROUP BY c.node)
SELECT round(avg(CASE WHEN n = 1 THEN 0e0 WHEN a < b THEN CASE WHEN isinf(b) THEN 1e0 ELSE 1e0 - a / b END WHEN a > b THEN b / a - 1e0 ELSE 0e0 END), 6) AS silhouette FROM ab""")
def silhouette(spark, sf):
    edges = word_edges(spark, sf)
    return clusters.silhouette(edges.toDF("a", "b", "similarity"), _members(edges)).select(r6("silhouette"))


@query("within_variance", f"""
WITH RECURSIVE {BOTH}, {_reach('comp', STRONG)},
ins AS (SELECT a.component, weight, avg(weight) OVER (PARTITION BY a.component) AS m FROM edges JOIN comp a ON a.node = src JOIN comp b ON b.node = dst
        WHERE a.component = b.component)
SELECT round(sum((weight - m) * (weight - m)) / count(*), 6) AS variance FROM ins""")
def within_variance(spark, sf):
    edges = word_edges(spark, sf)
    return clusters.within_variance(edges.toDF("a", "b", "similarity"), _members(edges)).select(r6("variance"))


_CONFIDENCE = f"""conf AS (
  SELECT c.component AS set_id, count(*) AS size, CASE WHEN count(*) < 2 THEN 1e0 ELSE coalesce(max(m), 0e0) END AS confidence
  FROM comp c LEFT JOIN (SELECT a.component, avg(weight) AS m FROM edges JOIN comp a ON a.node = src JOIN comp b ON b.node = dst
    WHERE a.component = b.component GROUP BY a.component) i ON i.component = c.component GROUP BY c.component)"""


def _sets(edges):
    members = _members(edges).toDF("id", "set_id")
    scored = edges.toDF("entry_a", "entry_b", "combined_score")
    return members, clusters.set_confidence(scored, members)


@query("set_confidence", f"""
WITH RECURSIVE {BOTH}, {_reach('comp', STRONG)}, {_CONFIDENCE} SELECT set_id, size, round(confidence, 6) AS confidence FROM conf""")
def set_confidence(spark, sf):
    _, sets = _sets(word_edges(spark, sf))
    return sets.select("set_id", "size", r6("confidence"))


@query("set_links", f"""
WITH RECURSIVE {BOTH}, {_reach('comp', STRONG)}, {_CONFIDENCE}
SELECT component AS source, node AS target, round(confidence, 6) AS weight FROM comp JOIN conf ON set_id = component WHERE node <> component""")
def set_links(spark, sf):
    members, sets = _sets(word_edges(spark, sf))
    return clusters.set_links(members, sets).select("source", "target", r6("weight"))


@query("similarity_network")
def similarity_network(spark, sf):
    """Coordinates of the entries behind strong edges, one row per node and its degree."""
    e = vector_entries(spark, sf)
    nodes, links = layout.similarity_network(e, word_edges(spark, sf), STRONG)
    ends = links.select(F.explode(F.array("source", "target")).alias("ipa")).groupBy("ipa").agg(F.count(F.lit(1)).alias("links"))
    return nodes.withColumn("ipa", F.lower("label")).join(ends, "ipa").select(
        "id", "label", "language", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "links"
    )
