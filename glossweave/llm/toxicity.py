"""Toxicity with a counterfactual penalty: swapping a group for another must not move the score.

Features are the words of a text and their beginnings, by presence, scaled by
their log-count ratio in toxic and other texts. A logistic regression is fitted
to them. For every training text that names a group, the name is swapped for the
next one of its list, and the squared change of the score is penalised, so that
the weights of group names, and of what only goes along with them, go together.

The fit uses at most ``rows`` labelled texts (those with the smallest hash of
their id); scoring covers all texts, by a table of at most ``most`` features.

Defined cases: null and empty texts have no features and score as the bias says.
Labels that are null are no labels; contradicting labels of one id, or of a
repeated row, count as rows of their own. Without labels of both kinds every
score is the share of toxic labels (0 without any). Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import fold, slices
from glossweave.session import materialize

# Names of groups, in lists whose members can stand for each other.
GROUPS = [
    ["men", "women"],
    ["man", "woman"],
    ["boys", "girls"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["immigrants", "refugees", "natives", "foreigners", "citizens"],
    ["disabled", "deaf", "blind", "autistic"],
    ["young", "old", "elderly"],
    ["männer", "frauen"],
    ["christen", "muslime", "juden", "hindus"],
    ["ausländer", "flüchtlinge", "einheimische"],
    ["hommes", "femmes"],
    ["chrétiens", "musulmans", "juifs", "hindous"],
    ["étrangers", "réfugiés", "immigrés"],
    ["hombres", "mujeres"],
    ["cristianos", "musulmanes", "judíos", "hindúes"],
    ["extranjeros", "refugiados", "inmigrantes"],
]
SWAP = {a: b for group in GROUPS for a, b in zip(group, group[1:] + group[:1])}
WORD = re.compile(r"[^\W\d_]+")
HEADS = (3, 4, 5, 6)


def parts(word: str) -> list[str]:
    """A word and its beginnings; beginnings are marked."""
    return [word, *(word[:n] + "~" for n in HEADS if len(word) > n)]


def features(bag: set[str]) -> set[str]:
    return {p for w in bag for p in parts(w)}


def bag_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swapped(bag: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in bag}


def sample(docs: DataFrame, labels: DataFrame, rows: int, label: str) -> DataFrame:
    """(toxic, bag array<string>) of the bounded sample."""
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("toxic")
    )
    ids = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                bags = [sorted(bag_of(t)) for t in piece["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([piece["toxic"], pa.array(bags, pa.list_(pa.string()))], ["toxic", "bag"])

    # At most ``rows`` ids of 12 bytes are broadcast.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(ids), "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, bag array<string>")


def counted(bags: DataFrame) -> DataFrame:
    """(feature, toxic, n): texts that show a feature, summed up within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, every = Counter(), Counter()
            for y, bag in zip(batch["toxic"].to_pylist(), batch["bag"].to_pylist()):
                found = features(set(bag))
                every.update(found)
                if y:
                    toxic.update(found)
            names = list(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([toxic[n] for n in names], pa.int64()), pa.array([every[n] for n in names], pa.int64())],
                ["feature", "toxic", "n"],
            )

    parts = bags.mapInArrow(run, "feature string, toxic long, n long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def fit_weights(
    x: list[np.ndarray], swaps: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: np.ndarray, penalty: float, fair: float,
    rounds: int = 400, rate: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows with the counterfactual penalty, by Adam on the whole sample."""
    n, size = len(y), len(scale)
    row = np.repeat(np.arange(n), [len(r) for r in x])
    col = np.concatenate(x) if n else np.empty(0, np.int64)
    pair = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps])
    pcol = np.concatenate([np.concatenate(s) for s in swaps]) if swaps else np.empty(0, np.int64)
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in swaps]) if swaps else np.empty(0)
    w, bias = np.zeros(size), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * scale[col], n) + bias, -40, 40)))
        rest = (p - y) / n
        grad = np.bincount(col, rest[row], size) * scale + penalty * w / n
        if len(swaps):
            moved = np.bincount(pair, sign * w[pcol] * scale[pcol], len(swaps))
            grad += 2 * fair / len(swaps) * np.bincount(pcol, sign * moved[pair], size) * scale
        g = np.append(grad, rest.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w * scale, float(bias)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 8000, most: int = 4096, least: int = 4, penalty: float = 1.0,
    fair: float = 1.0,
) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias."""
    bags = materialize(sample(docs, labels, rows, label), "bags")
    totals = bags.agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).first()
    a, n = int(totals["a"] or 0), int(totals["n"])
    if a in (0, n):
        return {}, float(np.log((a + 1e-9) / (n - a + 1e-9))) if n else -20.0
    # Association of presence and label (chi square up to a constant); group names always take part.
    table = counted(bags)
    chi = F.pow(F.col("toxic") * float(n) - F.col("n") * float(a), F.lit(2)) / (F.col("n") * (n - F.col("n") + 1.0))
    named = F.col("feature").isin(*SWAP)
    kept = table.filter((F.col("n") >= least) | named).orderBy(F.desc(named), F.desc(chi), "feature").limit(most).collect()
    index = {r["feature"]: i for i, r in enumerate(kept)}
    toxic, seen = (np.array([r[c] for r in kept], float) for c in ("toxic", "n"))
    ratio = np.log((toxic + 1) / (a + 2)) - np.log((seen - toxic + 1) / (n - a + 2))
    shared = bags.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        number = lambda bag: sorted(at[f] for f in features(bag) if f in at)
        for batch in batches:
            bags = [set(b) for b in batch["bag"].to_pylist()]
            others = [number(swapped(b)) if not SWAP.keys().isdisjoint(b) else None for b in bags]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], pa.array([number(b) for b in bags], kind), pa.array(others, kind)], ["toxic", "own", "other"]
            )

    # At most ``rows`` rows of at most ``most`` numbers each.
    found = bags.mapInArrow(run, "toxic int, own array<int>, other array<int>").toArrow()
    own = [np.array(r, np.int64) for r in found["own"].to_pylist()]
    other = found["other"].to_pylist()
    swaps = [(np.setdiff1d(o, c), np.setdiff1d(c, o)) for o, c in zip(own, [None if c is None else np.array(c, np.int64) for c in other]) if c is not None]
    y = found["toxic"].to_numpy().astype(float)
    # Rows come in any order; sums over them should not.
    order = sorted(range(len(y)), key=lambda i: (y[i], own[i].tolist()))
    swaps.sort(key=lambda s: (s[0].tolist(), s[1].tolist()))
    w, bias = fit_weights([own[i] for i in order], swaps, y[order], ratio, penalty, fair)
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, bias


def scored(docs: DataFrame, model: tuple[dict[str, float], float], column: str = "score") -> DataFrame:
    """All rows and columns, and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(column, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                out = []
                for text in piece["text"].to_pylist():
                    hit: set[str] = set()
                    for w in bag_of(text):
                        if (p := known.get(w)) is None:
                            p = tuple(x for x in parts(w) if x in weights)
                            if len(known) < 200_000:
                                known[w] = p
                        if p:
                            hit.update(p)
                    z = bias + sum(weights[h] for h in sorted(hit))
                    out.append(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))
                columns = [c for c in piece.schema.names if c != column]
                arrays = {**{c: piece[c] for c in columns}, column: pa.array(out, pa.float64())}
                yield pa.RecordBatch.from_arrays([arrays[f] for f in schema.names], schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def train_and_score(docs: DataFrame, labels: DataFrame, held_out: int | None = 5, **options) -> DataFrame:
    """Scores all documents by what the labels of the other folds teach (all labels if ``held_out`` is None)."""
    own = labels if held_out is None else labels.filter(fold("doc_id", held_out) != 0)
    return scored(docs, fit(docs, own, **options))
