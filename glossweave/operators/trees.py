"""Distance matrices of taxa, and one tree per group of taxa.

Taxa are languages or catalogued sources. Their number is fixed by a small
dimension, so the distances of one group always fit in one task; entries are
reduced to taxa before they get here. A tree is a table of branches: the set
of taxa below the branch and the branch length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from glossweave.operators.skew import MAX_TAXA, require_small_groups


def distances(similarities: DataFrame) -> DataFrame:
    """Full long-form matrix (grp, a, b, d) with d = 1 - similarity.

    Both orders, a zero diagonal, and 0 for pairs that were never compared.
    """
    given = similarities.select("grp", "a", "b", (1.0 - F.col("similarity")).alias("d"))
    both = given.unionByName(given.select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    taxa = require_small_groups(both.select("grp", F.col("a").alias("t")).distinct(), ["grp"], MAX_TAXA, "taxa")
    grid = taxa.withColumnRenamed("t", "a").join(taxa.withColumnRenamed("t", "b"), "grp")
    value = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("d", F.lit(0.0)))
    return grid.join(both, ["grp", "a", "b"], "left").select("grp", "a", "b", value.alias("d"))


# Lance-Williams updates: distance of a merged pair (sizes p, q) to a third group (size r).
_UPDATES = {
    "single": lambda dp, dq, d, p, q, r: np.minimum(dp, dq),
    "complete": lambda dp, dq, d, p, q, r: np.maximum(dp, dq),
    "average": lambda dp, dq, d, p, q, r: (p * dp + q * dq) / (p + q),
    "ward.D2": lambda dp, dq, d, p, q, r: np.sqrt(
        np.maximum(((p + r) * dp**2 + (q + r) * dq**2 - r * d**2) / (p + q + r), 0)
    ),
}


def _merges(names: list[str], matrix: np.ndarray, method: str) -> list[tuple[list[str], list[str], float]]:
    """Agglomeration steps (left taxa, right taxa, height), closest pair first."""
    groups = [[n] for n in names]
    d = matrix.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    steps = []
    while len(groups) > 1:
        i, j = sorted(divmod(int(d.argmin()), len(groups)))
        sizes = np.array([len(g) for g in groups], dtype=float)
        row = _UPDATES[method](d[i], d[j], d[i, j], sizes[i], sizes[j], sizes)
        steps.append((groups[i], groups[j], float(d[i, j])))
        keep = [k for k in range(len(groups)) if k not in (i, j)]
        merged = np.full((len(keep) + 1,) * 2, np.inf)
        merged[:-1, :-1] = d[np.ix_(keep, keep)]
        merged[-1, :-1] = merged[:-1, -1] = row[keep]
        groups = [groups[k] for k in keep] + [sorted(groups[i] + groups[j])]
        d = merged
    return steps


def _ultrametric_branches(names: list[str], matrix: np.ndarray, method: str) -> list[tuple[list[str], float]]:
    height = {(n,): 0.0 for n in names}
    branches = []
    for left, right, d in _merges(names, matrix, method):
        for side in (left, right):
            branches.append((side, d / 2 - height[tuple(side)]))
        height[tuple(sorted(left + right))] = d / 2
    return branches


def _joined_branches(names: list[str], matrix: np.ndarray) -> list[tuple[list[str], float]]:
    """Neighbour joining."""
    groups, d, branches = [[n] for n in names], matrix.astype(float).copy(), []
    while len(groups) > 2:
        n, total = len(groups), d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n))
        to_i = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        branches += [(groups[i], to_i), (groups[j], d[i, j] - to_i)]
        keep = [k for k in range(n) if k not in (i, j)]
        row = (d[i] + d[j] - d[i, j]) / 2
        merged = np.zeros((len(keep) + 1,) * 2)
        merged[:-1, :-1] = d[np.ix_(keep, keep)]
        merged[-1, :-1] = merged[:-1, -1] = row[keep]
        groups = [groups[k] for k in keep] + [sorted(groups[i] + groups[j])]
        d = merged
    if len(groups) == 2:
        branches.append((groups[0], float(d[0, 1])))
    return branches


def _branches(names: list[str], matrix: np.ndarray, method: str) -> list[tuple[list[str], float]]:
    if method in ("nj", "ml"):
        return _joined_branches(names, matrix)
    return _ultrametric_branches(names, matrix, "average" if method == "upgma" else method)


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    wide = pdf.pivot(index="a", columns="b", values="d").sort_index(axis=0).sort_index(axis=1)
    return [str(n) for n in wide.index], wide.to_numpy()


def check_taxa(matrix: DataFrame, most: int = MAX_TAXA) -> DataFrame:
    """The matrix itself, after a check that no group has more than ``most`` taxa."""
    require_small_groups(matrix.filter("a = b"), ["grp"], most, "taxa")
    return matrix


def dendrograms(matrix: DataFrame, method: str = "ward.D2") -> DataFrame:
    """Agglomerative clustering per group: merge steps with both sides and height."""
    _UPDATES[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        steps = _merges(names, d, method)
        return pd.DataFrame({
            "grp": pdf["grp"].iloc[0],
            "step": np.arange(1, len(steps) + 1),
            "left": [s[0] for s in steps],
            "right": [s[1] for s in steps],
            "height": [s[2] for s in steps],
        })

    schema = "grp string, step int, left array<string>, right array<string>, height double"
    return check_taxa(matrix).groupBy("grp").applyInPandas(one, schema)


def group_counts(merges: DataFrame) -> DataFrame:
    """Range of cluster numbers worth trying per group: 2 to min(10, taxa - 1)."""
    return merges.groupBy("grp").agg(
        F.lit(2).alias("k_low"), F.least(F.lit(10), F.count(F.lit(1))).cast("int").alias("k_high")
    )


def infer_trees(matrix: DataFrame, method: str = "nj") -> DataFrame:
    """One tree per group: (grp, clade, length) for every branch."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(pdf)
        found = _branches(names, d, method)
        return pd.DataFrame({
            "grp": pdf["grp"].iloc[0],
            "clade": [b[0] for b in found],
            "length": [float(b[1]) for b in found],
        })

    return check_taxa(matrix).groupBy("grp").applyInPandas(one, "grp string, clade array<string>, length double")


def tree_distances(branches: DataFrame, matrix: DataFrame) -> DataFrame:
    """Path length between taxa on the tree: the branches that separate them."""
    pairs = matrix.filter("a < b").select("grp", "a", "b", "d")
    cut = F.array_contains("clade", F.col("a")) != F.array_contains("clade", F.col("b"))
    met = pairs.join(branches, "grp").groupBy("grp", "a", "b", "d")
    return met.agg(F.sum(F.when(cut, F.col("length")).otherwise(0.0)).alias("on_tree"))


def tree_fit(branches: DataFrame, matrix: DataFrame) -> DataFrame:
    """Correlation of given and tree distances per group, with a verdict."""
    r = F.col("correlation")
    verdict = (
        F.when(r > 0.9, "Excellent tree fit").when(r > 0.8, "Good tree fit")
        .when(r > 0.7, "Moderate tree fit").otherwise("Poor tree fit - consider different method")
    )
    out = tree_distances(branches, matrix).groupBy("grp").agg(F.corr("d", "on_tree").alias("correlation"))
    return out.withColumn("interpretation", verdict)


def splits(branches: DataFrame, taxa: DataFrame) -> DataFrame:
    """Non-trivial splits of each tree, named by the side without the first taxon.

    ``taxa``: (grp, taxon).
    """
    listed = taxa.groupBy("grp").agg(F.array_sort(F.collect_set("taxon")).alias("all"))
    met = branches.join(listed, "grp")
    side = F.when(F.array_contains("clade", F.col("all")[0]), F.array_except("all", "clade")).otherwise(F.col("clade"))
    met = met.withColumn("side", F.array_sort(side)).filter(
        (F.size("side") > 1) & (F.size("side") < F.size("all") - 1)
    )
    return met.select("grp", F.array_join("side", ",").alias("split")).distinct()


def compare_trees(first: DataFrame, second: DataFrame, taxa: DataFrame) -> DataFrame:
    """Robinson-Foulds distance of two trees per group."""
    a = splits(first, taxa).withColumn("in_a", F.lit(1))
    b = splits(second, taxa).withColumn("in_b", F.lit(1))
    lone = a.join(b, ["grp", "split"], "full").filter("in_a is null or in_b is null")
    counted = lone.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sizes = taxa.groupBy("grp").agg(F.count_distinct("taxon").alias("taxa"))
    rf = F.coalesce("n", F.lit(0))
    most = 2 * (F.col("taxa") - 3)
    return sizes.join(counted, "grp", "left").select(
        "grp", rf.alias("robinson_foulds"), F.try_divide(rf, most).alias("normalized_rf"),
        most.alias("max_possible_rf"), (rf == 0).alias("trees_identical"),
    )


def bootstrap_support(matrix: DataFrame, replicates: int = 100, method: str = "nj", seed: int = 1) -> DataFrame:
    """Support of each split of the full tree over resampled sets of taxa.

    A replicate draws taxa with replacement and builds a tree of those drawn.
    It supports a split when that tree shows the split restricted to them; it
    has no say when the restriction is trivial. Replicates are rows, spread
    over all tasks. Splits with support above one half are returned.
    """
    matrix = check_taxa(matrix)
    row = F.struct("a", "b", "d")
    packed = matrix.groupBy("grp").agg(F.collect_list(row).alias("cells"))
    runs = packed.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    runs = runs.repartition("grp", "replicate")

    def side_of(clade, taxa: list[str]) -> frozenset:
        inside = frozenset(clade) & frozenset(taxa)
        return frozenset(taxa) - inside if taxa[0] in inside else inside

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grp, cells, replicate in zip(pdf["grp"], pdf["cells"], pdf["replicate"]):
                names, d = _matrix(pd.DataFrame(list(cells)))
                draw = np.random.default_rng([seed, replicate, *grp.encode()])
                drawn = sorted(set(draw.integers(0, len(names), len(names)).tolist()))
                some = [names[i] for i in drawn]
                found = {side_of(c, some) for c, _ in _branches(some, d[np.ix_(drawn, drawn)], method)}
                for clade, _ in _branches(names, d, method):
                    full, part = side_of(clade, names), side_of(clade, some)
                    if 1 < len(full) < len(names) - 1 and 1 < len(part) < len(some) - 1:
                        out.append((grp, ",".join(sorted(full)), float(part in found)))
            yield pd.DataFrame(out, columns=["grp", "split", "hit"])

    votes = runs.mapInPandas(run, "grp string, split string, hit double")
    support = votes.groupBy("grp", "split").agg(F.avg("hit").alias("support"), F.count(F.lit(1)).alias("replicates"))
    return support.filter("support > 0.5")
