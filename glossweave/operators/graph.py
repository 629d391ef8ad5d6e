"""Graph operators over an undirected edge table (src, dst, weight).

Loops keep their state as small tables in the shared folder (one row per node)
and join it to the written edge table, so the planner knows all sizes, splits
skewed partitions of the edge side and has no growing lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossweave.operators.windows import first_n, with_row_index
from glossweave.session import materialize, materialize_counting


def above(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter(F.col("weight") >= threshold)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge once per direction; a self loop stays single."""
    back = edges.filter("src <> dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]
    )
    return edges.unionByName(back)


def nodes_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components: (node, component), named after the smallest node.

    ``nodes`` (node, each once, all ends among them) may hold nodes without an edge, which stay on their own.

    Nodes are numbered once. In a round every node goes over to the one that
    comes first, in an order dealt anew, of those within two edges, and only
    the edges between different ones stay; so the graph shrinks by a share each
    round whatever its diameter. The rounds are then put together from the last.
    """
    named = edges.select("src", "dst")
    numbers = materialize((nodes_of(named) if nodes is None else nodes).withColumn("number", F.monotonically_increasing_id()), "numbers")
    end = lambda c: numbers.select(F.col("node").alias(c), F.col("number").alias(f"_{c}"))
    numbered = named.filter("src <> dst").join(end("src"), "src").join(end("dst"), "dst")
    links, left = _links(numbered.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    rounds = []
    while left:
        # The hash of one long is a permutation of all longs, another one each round.
        order = lambda c: F.xxhash64(c, F.lit(len(rounds)))
        to = both_ways(links).groupBy(F.col("src").alias("number")).agg(F.min(order("dst")).alias("near"))
        to = materialize(to.select("number", F.least("near", order("number")).alias("to")), "nearest")
        heard = both_ways(links).join(to.withColumnRenamed("number", "dst"), "dst").select(F.col("src").alias("number"), "to")
        to = materialize(heard.groupBy("number").agg(F.min("to").alias("to")), "contracted")
        # A second step, to where the neighbour goes, saves rounds.
        beyond = to.select(order("number").alias("to"), F.col("to").alias("_far"))
        to = materialize(to.join(beyond, "to").select("number", F.col("_far").alias("to")), "contracted")
        rounds.append(to)
        end = lambda c: to.select(F.col("number").alias(c), F.col("to").alias(f"_{c}"))
        links, left = _links(links.join(end("src"), "src").join(end("dst"), "dst").select(
            F.col("_src").alias("src"), F.col("_dst").alias("dst")
        ))
    found = None
    for number, to in reversed(list(enumerate(rounds))):
        # Numbers of different rounds are told apart by the round.
        here = to.select("number", "to", F.lit(number).alias("level"))
        if found is not None:
            here = here.join(found, here["to"] == found["_at"], "left").select(
                "number", F.coalesce("_to", "to").alias("to"), F.coalesce("_level", "level").alias("level")
            )
        found = materialize(here, "found").toDF("_at", "_to", "_level")
    if found is None:
        return numbers.select("node", F.col("node").alias("component"))
    placed = numbers.join(found, numbers["number"] == found["_at"], "left")
    placed = materialize(placed.select(
        "node", F.coalesce("_to", "number").alias("root"), F.coalesce("_level", F.lit(-1)).alias("level")
    ), "placed")
    linked = placed.filter("level >= 0")
    names = linked.groupBy("root", "level").agg(F.min("node").alias("component"))
    alone = placed.filter("level < 0").select("node", F.col("node").alias("component"))
    return linked.join(names, ["root", "level"]).select("node", "component").unionByName(alone)


def _links(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Every link of different ends once, and how many there are."""
    once = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src < dst").distinct()
    return materialize_counting(once, "true", "links")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def threshold_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """Components of the strong edges; every other endpoint stays on its own."""
    return components(above(edges, threshold), nodes_of(edges))


def stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, average degree, density and component count, one row."""
    edges = materialize(edges.select("src", "dst"), "edges")
    sizes = component_sizes(components(edges)).agg(
        F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components")
    )
    count = edges.agg(F.count(F.lit(1)).alias("edges"))
    n, e = F.col("nodes"), F.col("edges")
    return (
        sizes.withColumn("_one", F.lit(1)).join(count.withColumn("_one", F.lit(1)), "_one")
        .select(
            F.coalesce(n, F.lit(0)).alias("nodes"), "edges",
            F.coalesce(F.try_divide(2 * e, n), F.lit(0.0)).alias("avg_degree"),
            F.coalesce(F.try_divide(2 * e, n * (n - 1)), F.lit(0.0)).alias("density"),
            "components",
        )
    )


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, cut_every: int = 5) -> DataFrame:
    """Rank of each node with every edge counted the same in both directions."""
    links = materialize(both_ways(edges.select("src", "dst")), "links")
    base = materialize(links.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    n = base.count()
    if n == 0:
        return base.select(F.col("src").alias("node"), F.lit(0.0).alias("rank"))
    ranks = base.select(F.col("src").alias("node"), "degree", F.lit(1.0 / n).alias("rank"))
    idle = base.select(F.col("src").alias("node"), "degree", F.lit(0.0).alias("gift"))
    for turn in range(1, iterations + 1):
        given = links.join(ranks, links["src"] == ranks["node"]).select(
            F.col("dst").alias("node"), F.lit(None).cast("long").alias("degree"),
            (F.col("rank") / F.col("degree")).alias("gift"),
        )
        ranks = given.unionByName(idle).groupBy("node").agg(
            F.max("degree").alias("degree"), ((1.0 - damping) / n + damping * F.sum("gift")).alias("rank")
        )
        if turn % cut_every == 0:
            ranks = materialize(ranks, "ranks")
    return ranks.select("node", "rank")


def shortest_paths(edges: DataFrame, source: DataFrame) -> DataFrame:
    """Cheapest cost from the node in ``source`` (one row, column node) to all it reaches.

    Only nodes that became cheaper in the last round send offers in the next.
    Negative weights are refused: going to and fro would get cheaper for ever.
    """
    links = materialize(both_ways(edges.select("src", "dst", "weight")), "links")
    if not links.filter("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    known = materialize(
        source.select("node", F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")), "costs"
    )
    changed = 1
    while changed:
        active = known.filter("fresh").select(F.col("node").alias("src"), "cost")
        offers = links.join(active, "src").groupBy(F.col("dst").alias("node")).agg(
            F.min(F.col("cost") + F.col("weight")).alias("offer")
        )
        met = known.select("node", "cost").join(offers, "node", "full")
        better = F.coalesce(F.col("offer") < F.col("cost"), F.col("cost").isNull())
        known, changed = materialize_counting(
            met.select("node", F.least("cost", "offer").alias("cost"), better.alias("fresh")), "fresh", "costs"
        )
    return known.select("node", "cost")


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Edge-count modularity of a grouping (node, community), one row."""
    comm = lambda end: membership.select(F.col("node").alias(end), F.col("community").alias(f"_{end}"))
    placed = edges.select("src", "dst").join(comm("src"), "src").join(comm("dst"), "dst")
    # Each edge adds one degree at both ends and, inside a community, one internal edge.
    ends = placed.select(
        F.explode(F.array("_src", "_dst")).alias("community"),
        F.when(F.col("_src") == F.col("_dst"), 0.5).otherwise(0.0).alias("inside"),
    )
    per = ends.groupBy("community").agg(F.count(F.lit(1)).alias("degree"), F.sum("inside").alias("inside"))
    total = per.agg(
        F.sum("degree").alias("ends"), F.sum("inside").alias("inside"),
        F.sum(F.col("degree").cast("double") * F.col("degree")).alias("squares"),
    )
    m2 = F.col("ends").cast("double")
    score = F.try_divide(F.col("inside"), m2 / 2) - resolution * F.try_divide(F.col("squares"), m2 * m2)
    return total.select(F.coalesce(score, F.lit(0.0)).alias("modularity"))


def communities(edges: DataFrame, resolution: float = 1.0, sweeps: int = 10) -> DataFrame:
    """Communities by modularity moves: (node, community).

    In a sweep every node may move to the neighbouring community that raises
    modularity most. Half of the nodes move at a time, so two neighbours do
    not swap places; the best grouping seen is returned.

    Nodes are numbered once, in their own order. A half sends only the links of
    the nodes whose turn it is, once to where the neighbour is and once back.
    """
    pairs = edges.select("src", "dst").filter("src <> dst")
    # A node moves in the first or in the second half of each sweep.
    turns = F.concat(*[F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(2)).cast("string") for sweep in range(sweeps)])
    names = with_row_index(nodes_of(pairs).withColumn("turns", turns), ["node"], "number")
    names = materialize(names, "numbers")
    end = lambda c: names.select(F.col("node").alias(c), F.col("number").alias(f"_{c}"), F.col("turns").alias(f"_turns_{c}"))
    numbered = pairs.join(end("src"), "src").join(end("dst"), "dst")
    way = lambda a, b: numbered.select(F.col(f"_{a}").alias("src"), F.col(f"_{b}").alias("dst"), F.col(f"_turns_{a}").alias("turns"))
    links = materialize(way("src", "dst").withColumn("forward", F.lit(True)).unionByName(way("dst", "src").withColumn("forward", F.lit(False))), "links")
    m2 = float(links.count())
    if not m2:
        return names.select("node", F.col("node").alias("community"))
    state = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    state = _with_volumes(materialize(state.withColumn("community", F.col("node")), "communities"))
    best, best_score = state, _score(links, state, m2, resolution)
    for sweep in range(sweeps):
        for half in (0, 1):
            state = _move_half(links, state, m2, resolution, sweep, half)
        score = _score(links, state, m2, resolution)
        if score <= best_score:
            break
        best, best_score = state, score
    return _with_smallest_name(best, names)


def _with_volumes(state: DataFrame) -> DataFrame:
    """Adds the degrees of each node's community together."""
    volumes = state.groupBy("community").agg(F.sum("degree").alias("volume"))
    return materialize(state.join(volumes, "community"), "volumes")


def _score(links: DataFrame, state: DataFrame, m2: float, resolution: float) -> float:
    """:func:`modularity` of a grouping whose degrees and volumes are known."""
    place = lambda end: state.select(F.col("node").alias(end), F.col("community").alias(f"_{end}"))
    inside = links.filter("forward").select("src", "dst").join(place("dst"), "dst").join(place("src"), "src").filter("_src = _dst").count()
    squares = state.agg(F.sum(F.col("degree").cast("double") * F.col("volume"))).first()[0]
    return inside / (m2 / 2) - resolution * (squares / (m2 * m2))


def _move_half(links: DataFrame, state: DataFrame, m2: float, resolution: float, sweep: int, half: int) -> DataFrame:
    mine = links.filter(F.substring("turns", sweep + 1, 1) == str(half)).select(F.col("src").alias("node"), "dst")
    there = state.select(F.col("node").alias("dst"), F.col("community").alias("target"), F.col("volume").alias("there"))
    # Dealt by node, so that ties, gains and moves of a node need no further shuffle.
    ties = mine.join(there, "dst").select("node", "target", "there").repartition("node")
    ties = ties.groupBy("node", "target").agg(F.count(F.lit(1)).alias("ties"), F.first("there").alias("there"))
    rated = state.join(ties, "node", "left")
    own = F.col("target") == F.col("community")
    others = F.col("there") - F.when(own, F.col("degree")).otherwise(F.lit(0))
    gain = lambda ties, others: ties / m2 - resolution * F.col("degree") * others / (m2 * m2)
    # Ties in gain: stay where you are, else the smaller name.
    worth = F.struct((-F.round(gain(F.col("ties"), others), 12)).alias("loss"), (~own).alias("leaves"), F.col("target"))
    alone = gain(F.lit(0).cast("long"), F.col("volume") - F.col("degree"))
    # Staying is an option also where no neighbour is of the same community.
    stay = F.struct((-F.round(alone, 12)).alias("loss"), F.lit(False).alias("leaves"), F.col("community").alias("target"))
    best = rated.groupBy("node").agg(
        F.first("degree").alias("degree"), F.first("community").alias("community"),
        F.min(F.when(F.col("target").isNotNull(), worth)).alias("best"), F.first(stay).alias("stay"),
    )
    pick = F.when(F.col("best").isNull(), F.col("community")).otherwise(F.least("best", "stay")["target"])
    return _with_volumes(materialize(best.select("node", "degree", pick.alias("community")), "communities"))


def _with_smallest_name(state: DataFrame, names: DataFrame) -> DataFrame:
    """Every node's name with the first name of its community."""
    first = state.groupBy("community").agg(F.min("node").alias("number"))
    first = first.join(names, "number").select("community", F.col("node").alias("name"))
    placed = state.select(F.col("node").alias("number"), "community").join(names, "number").select("node", "community")
    return placed.join(first, "community").select("node", F.col("name").alias("community"))


def sparse_entries(edges: DataFrame, threshold: float) -> DataFrame:
    """Cells (i, j, value) of the symmetric similarity matrix.

    Every endpoint, also of weak edges, owns a diagonal cell of 1; repeated
    edges add up.
    """
    kept = both_ways(above(edges.select("src", "dst", "weight"), threshold)).toDF("i", "j", "value")
    diagonal = nodes_of(edges).select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("value"))
    return kept.unionByName(diagonal).groupBy("i", "j").agg(F.sum("value").alias("value"))


def sparse_facts(edges: DataFrame, threshold: float) -> DataFrame:
    """Matrix side, stored cells and share of empty cells, one row."""
    cells = sparse_entries(edges, threshold)
    facts = cells.agg(F.count_if(F.col("i") == F.col("j")).alias("n"), F.count(F.lit(1)).alias("nnz"))
    n = F.col("n").cast("double")
    return facts.select("n", "nnz", F.coalesce(1.0 - F.try_divide("nnz", n * n), F.lit(0.0)).alias("sparsity"))


def matvec(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """Matrix times vector; ``vector``: (node, x). Rows without a match give 0."""
    met = cells.join(vector.select(F.col("node").alias("j"), "x"), "j", "left")
    return met.groupBy(F.col("i").alias("node")).agg(F.sum(F.coalesce(F.col("value") * F.col("x"), F.lit(0.0))).alias("y"))


def submatrix(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Stored cells among chosen nodes (node); a cell that is absent is 0."""
    pick = lambda end: chosen.select(F.col("node").alias(end)).distinct()
    return cells.join(pick("i"), "i", "left_semi").join(pick("j"), "j", "left_semi").select("i", "j", "value")


def nearest(edges: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """k best neighbours of every node; equal scores go to the larger id."""
    kept = above(edges, threshold) if threshold is not None else edges
    sides = both_ways(kept.select("src", "dst", "weight").filter("src <> dst"))
    return first_n(sides, ["src"], [F.desc("weight"), F.desc("dst")], k)


def neighbours(edges: DataFrame, node, threshold: float) -> DataFrame:
    touching = edges.filter((F.col("src") == node) | (F.col("dst") == node)).filter("src <> dst")
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    return above(touching, threshold).select(other.alias("neighbour"), "weight")


def export(edges: DataFrame, path: str) -> None:
    """Node and edge files for a graph view."""
    nodes_of(edges).select(F.col("node").alias("id")).write.json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight").write.json(f"{path}/edges")


def dense_rows(cells: DataFrame, ids: list) -> DataFrame:
    """Dense rows of the matrix for a caller's list of ids: (i, values in list order)."""
    wanted = F.array(*map(F.lit, ids))
    kept = cells.filter(F.col("i").isin(ids) & F.col("j").isin(ids))
    row = F.map_from_entries(F.collect_list(F.struct("j", "value")))
    rows = kept.groupBy("i").agg(row.alias("_row"))
    cell = lambda j: F.coalesce(F.try_element_at("_row", j), F.lit(0.0))
    return rows.select("i", F.transform(wanted, cell).alias("values"))
