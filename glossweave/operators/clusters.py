"""Grouping entries by pairwise scores, and judging the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from glossweave.operators.windows import first_n
from glossweave.session import materialize, materialize_counting, share


def leader_clusters(
    entries: DataFrame,
    block: str,
    score: Callable[[DataFrame], DataFrame],
    threshold: float,
    batch: int = 256,
) -> DataFrame:
    """Star clusters in id order inside each block: (block, id, leader).

    The first free entry leads a cluster and takes every free entry that scores
    at least ``threshold`` with it. ``score`` adds a column ``combined`` to
    rows that hold two entry structs ``a`` and ``b``; it may drop rows that
    cannot reach the threshold.

    Per round the next ``batch`` free entries of each block are settled among
    themselves; the leaders that come out meet the free entries of the block
    once. So no two followers are ever paired, a large block stays spread over
    all tasks, and the outcome equals the one-by-one procedure.
    """
    fields = F.struct(*[c for c in entries.columns if c != block])
    free, left = materialize_counting(
        entries.filter(F.col(block).isNotNull()).select(block, "id", fields.alias("e")), "true", "free"
    )
    done = free.select(block, "id", F.col("id").alias("leader")).limit(0)
    # Every round settles the first free entry of each block at least.
    while left:
        free = share(free)
        leaders = materialize(_next_leaders(free, block, score, threshold, batch), "leaders")
        met = free.join(leaders.select(block, F.col("e").alias("a")), block).withColumnRenamed("e", "b")
        own = leaders.select(block, "id", F.col("id").alias("leader"))
        others = score(met.filter(F.col("a.id") < F.col("b.id"))).filter(F.col("combined") >= threshold)
        links = others.select(block, F.col("b.id").alias("id"), F.col("a.id").alias("leader")).unionByName(own)
        taken = materialize(links.groupBy(block, "id").agg(F.min("leader").alias("leader")), "taken")
        done = done.unionByName(taken)
        rest = free.join(taken.select("id"), "id", "left_anti").select(block, "id", "e")
        free, left = materialize_counting(rest, "true", "free")
    return done


def _next_leaders(free: DataFrame, block: str, score, threshold: float, batch: int) -> DataFrame:
    candidates = first_n(free, [block], ["id"], batch).drop("rank")
    a = candidates.select(block, F.col("e").alias("a"))
    b = candidates.select(block, F.col("e").alias("b"))
    close = score(a.join(b, block).filter(F.col("a.id") < F.col("b.id"))).filter(F.col("combined") >= threshold)
    earlier = close.groupBy(F.col("b.id").alias("id")).agg(F.collect_set("a.id").alias("earlier"))
    known = candidates.select(block, "id").join(earlier, "id", "left")
    # At most ``batch`` rows per block, in id order.
    none = F.array().cast(f"array<{dict(candidates.dtypes)['id']}>")
    row = F.struct("id", F.coalesce("earlier", none).alias("earlier"))
    listed = known.groupBy(block).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lead = F.aggregate(
        "rows", none,
        lambda acc, r: F.when(F.arrays_overlap(acc, r["earlier"]), acc).otherwise(F.concat(acc, F.array(r["id"]))),
    )
    chosen = listed.select(F.explode(lead).alias("id"))
    return candidates.join(chosen, "id", "left_semi")


def greedy_leaders(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Star clusters in id order on an edge table: (id, leader).

    ``ids`` has a column id; ``edges`` a and b say which entries score enough.
    The first free entry leads and takes its free neighbours. Per round, entries
    without a smaller undecided neighbour lead and their neighbours are decided,
    so rounds are as many as the longest chain of such decisions, not as the
    entries; edges of decided entries drop out. A follower belongs to its
    smallest leader, as if entries were taken one by one.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialize(links, "links")
    # Entries without any edge are decided at once and stay out of the rounds.
    alone = ids.select("id").distinct().join(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
    free, left = materialize_counting(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "true", "free")
    open_links, leaders = links, None
    while left:
        first = free.join(open_links.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        # Each round keeps its leaders in a table of its own; the union of these is read at the end.
        first = materialize(first, "leaders")
        leaders = first if leaders is None else leaders.unionByName(first)
        taken = open_links.join(first.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        free, left = materialize_counting(
            free.join(taken, "id", "left_anti").join(first, "id", "left_anti"), "true", "free"
        )
        if left:
            ends = lambda c: free.select(F.col("id").alias(c))
            open_links = materialize(open_links.join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi"), "open")
    own = alone.select("id", F.col("id").alias("leader"))
    if leaders is None:
        return own
    leaders = materialize(leaders, "leaders")
    led = links.join(leaders.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return own.unionByName(leaders.select("id", F.col("id").alias("leader"))).unionByName(led)


def set_confidence(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Mean score of the scored pairs inside each set; 1 alone, 0 without pairs.

    ``edges``: entry_a, entry_b, combined_score; ``members``: set_id, id.
    """
    side = lambda s: members.select(F.col("id").alias(f"entry_{s}"), F.col("set_id").alias(f"set_{s}"))
    inside = edges.join(side("a"), "entry_a").join(side("b"), "entry_b").filter("set_a = set_b")
    mean = inside.groupBy(F.col("set_a").alias("set_id")).agg(F.avg("combined_score").alias("mean"))
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    confidence = F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("mean", F.lit(0.0)))
    return sizes.join(mean, "set_id", "left").select("set_id", "size", confidence.alias("confidence"))


def cognate_sets(members: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per set: id, size, confidence and the first member's definition.

    ``members`` come from :func:`leader_clusters`; the leader is the first member.
    """
    sets = set_confidence(edges, members.select(F.col("leader").alias("set_id"), "id"))
    core = entries.select(F.col("id").alias("set_id"), F.col("definition").alias("semantic_core"))
    return sets.join(core, "set_id").select(
        F.concat(F.lit("cognate_set_"), F.col("set_id")).alias("id"), "size", "confidence", "semantic_core"
    )


def cluster_rows(members: DataFrame, entries: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per star cluster: its concept, first form, languages, size and confidence.

    ``members``: concept_id, id, leader; ``sets``: set_id (the leader), size, confidence.
    """
    spoken = members.join(entries.select("id", "language"), "id")
    languages = spoken.groupBy("leader").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    heads = members.filter(F.col("id") == F.col("leader")).select("concept_id", "leader")
    forms = entries.select(F.col("id").alias("leader"), F.col("headword").alias("representative_form"))
    out = heads.join(forms, "leader").join(languages, "leader")
    return out.join(sets.withColumnRenamed("set_id", "leader"), "leader")


def set_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of a set for a network view: every member to the first one.

    The weight is the confidence of the set. A hub keeps the set connected
    with one link per member where a clique would need their square.
    """
    # Written, so that the join below meets two plain tables and a set with very
    # many members can be split over tasks.
    hubs = materialize(members.groupBy("set_id").agg(F.min("id").alias("source")), "hubs")
    met = members.join(hubs, "set_id").filter(F.col("id") != F.col("source"))
    return met.join(sets.select("set_id", F.col("confidence").alias("weight")), "set_id").select(
        "source", F.col("id").alias("target"), "weight"
    )


def _labelled(pairs: DataFrame, members: DataFrame) -> DataFrame:
    side = lambda s: members.select(F.col("id").alias(s), F.col("cluster").alias(f"cluster_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def silhouette(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Mean silhouette over all points, from the scored pairs alone, one row.

    ``pairs``: a, b, similarity; ``members``: id, cluster. Distance is
    1 - similarity. A lone point counts 0; a point that no pair links to
    another cluster counts 1 when it has distance inside its own.
    """
    placed = _labelled(pairs, members)
    gap = (1.0 - F.col("similarity")).alias("gap")
    ends = placed.select(F.col("a").alias("id"), F.col("cluster_a").alias("own"), F.col("cluster_b").alias("other"), gap).unionByName(
        placed.select(F.col("b").alias("id"), F.col("cluster_b").alias("own"), F.col("cluster_a").alias("other"), gap)
    )
    means = ends.groupBy("id", "own", "other").agg(F.avg("gap").alias("mean"))
    per = means.groupBy("id").agg(
        F.max(F.when(F.col("own") == F.col("other"), F.col("mean"))).alias("inner"),
        F.min(F.when(F.col("own") != F.col("other"), F.col("mean"))).alias("outer"),
    )
    sizes = materialize(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "sizes")
    points = members.join(sizes, "cluster").join(per, "id", "left")
    inner = F.coalesce("inner", F.lit(0.0))
    outer = F.coalesce("outer", F.lit(float("inf")))
    value = (
        F.when(F.col("size") == 1, 0.0)
        .when(inner < outer, 1.0 - inner / outer)
        .when(inner > outer, outer / inner - 1.0)
        .otherwise(0.0)
    )
    return points.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def within_variance(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Squared deviation of pair scores from their cluster's mean, pooled, one row."""
    inside = _labelled(pairs, members).filter("cluster_a = cluster_b")
    per = inside.groupBy("cluster_a").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("similarity").alias("variance")
    )
    pooled = F.try_divide(F.sum(F.col("n") * F.col("variance")), F.sum("n"))
    return per.agg(F.coalesce(pooled, F.lit(0.0)).alias("variance"))
