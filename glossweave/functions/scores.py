"""Combining sound, meaning and ancestry into one score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights of (semantic, phonetic, etymological) per question.
WEIGHTS = {
    "cognate": (0.3, 0.6, 0.1),
    "semantic": (0.7, 0.2, 0.1),
    "historical": (0.1, 0.4, 0.5),
    "balanced": (0.4, 0.4, 0.2),
}

# Shares of sound and meaning in the two-signal score.
SOUND_SHARE, MEANING_SHARE = 0.6, 0.4

# Chance of common origin by tree distance (upper bound, chance).
ORIGIN_CHANCE = ((0, 1.0), (1, 0.4), (2, 0.3), (4, 0.15), (6, 0.08), (10, 0.03))
ORIGIN_CHANCE_BEYOND = 0.001

# Fixed value: score of common origin where there is no evidence at all.
NO_EVIDENCE_ORIGIN = 0.1


def two_signal(phonetic: Column, semantic: Column) -> Column:
    return phonetic * SOUND_SHARE + semantic * MEANING_SHARE


def origin_chance(tree_distance: Column) -> Column:
    (bound, chance), *rest = ORIGIN_CHANCE
    ladder = F.when(tree_distance <= bound, chance)
    for bound, chance in rest:
        ladder = ladder.when(tree_distance <= bound, chance)
    return ladder.otherwise(ORIGIN_CHANCE_BEYOND)


def etymological(semantic: Column, phonetic: Column, tree_distance: Column) -> Column:
    evidence = (semantic + phonetic) / 2
    return origin_chance(tree_distance) * evidence + (1 - evidence) * NO_EVIDENCE_ORIGIN


def weights_map(weights: tuple[float, float, float]) -> Column:
    names = ("semantic", "phonetic", "etymological")
    return F.create_map(*[F.lit(x) for pair in zip(names, weights) for x in pair])


def layered(semantic: Column, phonetic: Column, origin: Column, weights: Column) -> Column:
    """Weighted sum with the weights taken from a map column."""
    return weights["semantic"] * semantic + weights["phonetic"] * phonetic + weights["etymological"] * origin
