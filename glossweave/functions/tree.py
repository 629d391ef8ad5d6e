"""The language tree as columns: ancestry, distance, branch and family."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossweave.functions.scores import ORIGIN_CHANCE, ORIGIN_CHANCE_BEYOND, origin_chance

# Every branch with the branch above it.
PARENT = {
    "indo_iranian": "pie", "indic": "indo_iranian", "iranian": "indo_iranian",
    "hellenic": "pie", "italic": "pie", "romance": "italic", "germanic": "pie",
    "west_germanic": "germanic", "north_germanic": "germanic", "celtic": "pie",
    "insular_celtic": "celtic", "balto_slavic": "pie", "baltic": "balto_slavic",
    "slavic": "balto_slavic", "east_slavic": "slavic", "west_slavic": "slavic",
    "south_slavic": "slavic", "armenian": "pie", "albanian": "pie",
    "anatolian": "pie", "tocharian": "pie",
    "south_dravidian_i": "proto_dravidian", "south_central_dravidian": "proto_dravidian",
    "finnic": "proto_uralic", "ugric": "proto_uralic",
}

# The languages of each branch.
MEMBERS = {
    "indic": "sa hi bn pa ur mr gu", "iranian": "fa ps tg ku", "hellenic": "el grc",
    "romance": "la it es fr pt ro ca", "west_germanic": "en de nl af yi",
    "north_germanic": "sv da no is fo", "insular_celtic": "ga gd cy br gv",
    "baltic": "lt lv", "east_slavic": "ru uk be", "west_slavic": "pl cs sk",
    "south_slavic": "bg mk sl hr sr", "armenian": "hy", "albanian": "sq",
    "south_dravidian_i": "ta ml kn", "south_central_dravidian": "te",
    "finnic": "fi et", "ugric": "hu",
}

# Family of each root, and the distances that stand for "no path".
FAMILY = {"pie": "indo-european", "proto_dravidian": "dravidian", "proto_uralic": "uralic"}
OTHER_FAMILY, UNKNOWN_LANGUAGE = 15, 999


def ancestry(node: str) -> list[str]:
    """Nodes from the root down to this one."""
    return (ancestry(PARENT[node]) if node in PARENT else []) + [node]


def language_rows() -> list[tuple]:
    rows = []
    for node, codes in MEMBERS.items():
        path = ancestry(node)
        for code in codes.split():
            rows.append((code, node, len(path) - 1, path[1], FAMILY[path[0]], path))
    return rows


def languages(spark: SparkSession) -> DataFrame:
    """One row per language of the tree; a fixed dimension, safe to broadcast."""
    return spark.createDataFrame(
        language_rows(),
        "iso_code string, node string, depth int, branch string, family string, path array<string>",
    )


def branch_codes(branch: str) -> list[str]:
    """Languages under a branch at any depth."""
    return [code for code, _, _, _, _, path in language_rows() if branch in path]


def with_tree(df: DataFrame, code: str, prefix: str) -> DataFrame:
    """Adds depth, branch, family and path of the language in column ``code``."""
    dim = languages(df.sparkSession).select(
        F.col("iso_code").alias(f"{prefix}_iso"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("depth", "branch", "family", "path")],
    )
    joined = df.join(F.broadcast(dim), df[code] == dim[f"{prefix}_iso"], "left")
    return joined.drop(f"{prefix}_iso")


def path_distance(df: DataFrame, a: str, b: str, mode: str = "depth_sum") -> Column:
    """Distance of two languages already joined by :func:`with_tree` as a and b.

    ``depth_sum`` adds the depths of both branches; ``lca`` counts the edges
    over their closest common branch, at least one for two different languages.
    """
    depth_a, depth_b = F.col("a_depth"), F.col("b_depth")
    if mode == "depth_sum":
        within = depth_a + depth_b
    elif mode == "lca":
        shared = F.zip_with("a_path", "b_path", lambda x, y: F.coalesce(x == y, F.lit(False)))
        common = F.size(F.filter(shared, lambda same: same))
        edges = F.size("a_path") + F.size("b_path") - 2 * common
        within = F.greatest(edges, F.lit(1))
    else:
        raise ValueError(f"unknown distance mode: {mode}")
    return (
        F.when(F.col(a) == F.col(b), 0)
        .when(depth_a.isNull() | depth_b.isNull(), UNKNOWN_LANGUAGE)
        .when(F.col("a_family") != F.col("b_family"), OTHER_FAMILY)
        .otherwise(within)
    )


def add_tree_distance(
    df: DataFrame, a: str, b: str, name: str = "tree_distance", mode: str = "depth_sum", keep: bool = False
) -> DataFrame:
    out = with_tree(with_tree(df, a, "a"), b, "b")
    out = out.withColumn(name, path_distance(out, a, b, mode))
    extra = [f"{p}_{c}" for p in "ab" for c in ("depth", "branch", "family", "path")]
    return out if keep else out.drop(*extra)


def chance_matrix(codes: list[str | None]) -> np.ndarray:
    """Chance of common origin of every two of some languages, as :func:`path_distance` (``depth_sum``) and ``origin_chance`` say."""
    known = {code: (depth, family) for code, _, depth, _, family, _ in language_rows()}
    depth = np.array([known.get(c, (UNKNOWN_LANGUAGE, ""))[0] for c in codes])
    family = np.array([known.get(c, (0, ""))[1] for c in codes])
    distance = np.where(family[:, None] == family, depth[:, None] + depth, OTHER_FAMILY)
    unknown = np.array([c not in known for c in codes])
    distance[unknown[:, None] | unknown] = UNKNOWN_LANGUAGE
    named = np.array([i for i, c in enumerate(codes) if c is not None], "int64")
    distance[named, named] = 0
    chance = np.full(distance.shape, ORIGIN_CHANCE_BEYOND)
    for bound, value in reversed(ORIGIN_CHANCE):
        chance[distance <= bound] = value
    return chance


def language_pairs(spark: SparkSession) -> DataFrame:
    """Distance and chance of common origin for every pair of tree languages, a < b."""
    codes = sorted(row[0] for row in language_rows())
    pairs = spark.createDataFrame(list(combinations(codes, 2)), "lang_a string, lang_b string")
    out = add_tree_distance(pairs, "lang_a", "lang_b")
    return out.withColumn("prior_probability", origin_chance(F.col("tree_distance")))
