"""Language-model scores of documents: prediction by partial matching over bytes.

Byte contexts up to ``order`` bytes (``op7`` asks for 5) are counted over all
training documents. A context predicts the bytes it has seen and escapes to the
next shorter one with method C (as many escapes as distinct bytes); bytes that a
longer context has seen are excluded from the shorter ones. Since the bytes
seen behind a context are among those seen behind its suffix, the exclusion
depends on the context alone. So every context has one number for what it takes
to leave it, one for what its own bytes share, and one for what its suffix has
left without them; the chain of escapes is a difference of two of these.

Byte 255, which no UTF-8 text holds, stands before a text and ends it, so the
probabilities of all texts add up to one at most.

The groups of a longest context and its byte are a table that grows with the
corpus. A task holds the log probabilities of the frequent ones (``most`` at
most, 2,097,152, 24 MiB) and contexts up to two bytes, which number at most 256 +
65,536. All other groups are gathered per document and looked up in the tables
of the longer contexts by a join. ``most`` does not change the scores.

Beside the model stands the add-one word model of the query's base score: words
and an end mark, counted over the training documents. The ``frequent`` words
(65,536 at most) go to every task; rarer ones are looked up by a join.

Defined cases: null counts as an empty text, which is an end mark alone. Rows
with equal ids or texts are scored each on its own. With no training text
every byte has probability 1/256; N and V are then zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import WordNumbers, fold, slices, words
from glossweave.session import materialize

ORDER = 3
LOW = 2
END = 255
FREQUENT = 65_536
MOST = 2_097_152


def symbols(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The context and the symbol at every place as one number of ``order`` + 1 bytes, and where each text ends."""
    start = b"\xff" * order
    data = [start + t.encode("utf-8", "surrogatepass") + b"\xff" if t else start + b"\xff" for t in texts]
    lengths = np.array([len(d) for d in data], np.int64)
    b = np.frombuffer(b"".join(data), np.uint8)
    if not len(b):
        return np.empty(0, np.int64), lengths
    n = len(b) - order
    code = b[:n].astype(np.int64)
    for k in range(1, order + 1):
        code <<= 8
        code |= b[k : n + k]
    keep = np.ones(n, bool)
    # Places that reach over a border between two texts.
    for k in range(order):
        borders = np.cumsum(lengths)[:-1] - 1 - k
        keep[borders] = False
    return code[keep], np.cumsum(lengths - order)


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(count, first) if len(first) else count


def count_both(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n) partial counts: 'g' groups of ``order`` + 1 bytes, 'w' words by number, 'e' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[list[np.ndarray]] = [[], []]
        tokens: Counter = Counter()
        ends = waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            number = WordNumbers(0)
            ws, (found, often) = list(tokens), summed(*grams)
            keys = np.concatenate([found, number.of(ws).view(np.int64), [0]])
            kinds = ["g"] * len(found) + ["w"] * len(ws) + ["e"]
            n = np.concatenate([often, np.fromiter(tokens.values(), np.int64, len(ws)), [ends]])
            for i in range(0, len(kinds), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[part]), pa.array(keys[part]), pa.array(n[part], pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece["text"].to_pylist()
                found, n = np.unique(symbols(texts, order)[0], return_counts=True)
                grams[0].append(found)
                grams[1].append(n.astype(np.int64))
                waiting += len(found)
                for t in texts:
                    tokens.update(words(t))
                ends += len(texts)
                if waiting > 2_000_000:
                    found, n = summed(*grams)
                    grams, waiting = [[found], [n]], len(found)
                if len(tokens) > 400_000 or waiting > 1_000_000:
                    yield from out()
                    grams, tokens, ends, waiting = [[], []], Counter(), 0, 0
        yield from out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, key long, n long")


class Short:
    """Contexts up to two bytes, from the three-byte groups (two of context) of the whole corpus, sorted, with counts.

    For a context: ``own`` is what its bytes are divided by, ``up`` the way out of
    it and down to the shortest context, ``behind`` that way without its first
    step, and ``down`` what a byte of its suffix gives back of it.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n2 = keys, n.astype(np.float64)
        self.n1 = np.bincount(keys & 0xFFFF, n, 1 << 16)
        self.n0 = np.bincount(keys & 0xFF, n, 256)
        none = np.zeros(1)
        self.sums, self.kinds = [self.n0.sum()[None]], [(self.n0 > 0).sum()[None].astype(np.float64)]
        self.behind, self.down = [none], [none]
        one = np.arange(1 << 16)[self.n1 > 0]
        for size, groups, count, less in ((1, one, self.n1[one], self.n0[one & 0xFF]), (2, keys, self.n2, self.n1[keys & 0xFFFF])):
            context, width = groups >> 8, 1 << (8 * size)
            sums, kinds, met = (np.bincount(context, w, width) for w in (count, None, less))
            suffix = np.arange(width) & ((1 << (8 * (size - 1))) - 1)
            left = np.where(kinds > 0, self.kinds[-1][suffix] - kinds, 0)
            room = np.maximum(self.sums[-1][suffix] - met + left, 1)
            behind = self.behind[-1][suffix] + np.where(left > 0, np.log10(np.maximum(left, 1) / room), 0)
            self.sums.append(sums)
            self.kinds.append(kinds.astype(np.float64))
            self.behind.append(behind)
            self.down.append(behind + np.log10(room))
        self.own = [np.log10(np.maximum(s + k, 1)) for s, k in zip(self.sums, self.kinds)]
        self.up = [np.log10(np.maximum(k, 1)) - o + b for k, o, b in zip(self.kinds, self.own, self.behind)]
        self.nothing = -np.log10(max(1.0, 256 - self.kinds[0][0]))

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, two, alone): what a byte gives once a longer context is left; whether the context of two bytes has it
        (what the context of three bytes gives back is then to be taken off); the log probability if no longer one was seen."""
        pair, two, one, symbol = codes & 0xFFFFFF, (codes >> 8) & 0xFFFF, (codes >> 8) & 0xFF, codes & 0xFF
        n2 = np.zeros(len(codes))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            n2 = np.where(self.keys[at] == pair, self.n2[at], 0)
        n1, n0 = self.n1[codes & 0xFFFF], self.n0[symbol]
        log = lambda n: np.log10(np.maximum(n, 1))
        part = np.where(n2 > 0, log(n2), np.where(n1 > 0, log(n1) - self.down[2][two], np.where(n0 > 0, log(n0) - self.down[1][one], self.nothing)))
        zero = np.zeros(len(codes), np.int64)
        alone = np.full(len(codes), self.nothing)
        for size, context, n in ((0, zero, n0), (1, one, n1), (2, two, n2)):
            asked = np.where(n > 0, log(n) - self.own[size][context], self.up[size][context] + part)
            alone = np.where(self.sums[size][context] > 0, asked, alone)
        return part, n2 > 0, alone


def groups_of(counts: DataFrame, order: int) -> dict[int, DataFrame]:
    """(key, n) by the length of the context: groups of a context and a symbol."""
    out = {order: counts.filter("kind = 'g'").select("key", "n")}
    for size in range(order - 1, LOW - 1, -1):
        short = F.col("key").bitwiseAND(F.lit((1 << (8 * (size + 1))) - 1))
        out[size] = out[size + 1].groupBy(short.alias("key")).agg(F.sum("n").alias("n"))
        if size > LOW:
            out[size] = materialize(out[size], f"groups{size}")
    return out


def frequent_groups(counts: DataFrame, most: int) -> DataFrame:
    """(key, log) of the most frequent groups, ``most`` at most; whole classes of nearly equal frequency."""
    groups = counts.filter("kind = 'g'").select("key", "n", F.floor(F.log2("n") * 16).alias("often"))
    # At most 16 classes for each power of two.
    classes = sorted(((r["often"], r["c"]) for r in groups.groupBy("often").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    least, total = 1 << 20, 0
    for often, c in classes:
        total += c
        if total > most:
            break
        least = often
    sums = groups.groupBy(F.shiftright("key", 8).alias("context")).agg((F.sum("n") + F.count(F.lit(1))).alias("all"))
    kept = groups.filter(F.col("often") >= least).withColumn("context", F.shiftright("key", 8))
    return kept.join(sums, "context").select("key", F.log10(F.col("n") / F.col("all")).cast("float").alias("log"))


def contexts_of(groups: dict[int, DataFrame], short: Short) -> DataFrame:
    """(size, context, own, up, down) of all contexts longer than ``LOW`` bytes."""
    spark = groups[LOW].sparkSession
    seen = np.flatnonzero(short.sums[LOW] > 0)
    above = spark.createDataFrame(pa.table({
        "suffix": seen, "s": short.sums[LOW][seen].astype(np.int64), "d": short.kinds[LOW][seen].astype(np.int64), "b": short.behind[LOW][seen],
    }))
    out = None
    for size in range(LOW + 1, max(groups) + 1):
        less = groups[size - 1].select(F.col("key").alias("short"), F.col("n").alias("less"))
        named = groups[size].withColumn("short", F.col("key").bitwiseAND(F.lit((1 << (8 * size)) - 1)))
        own = named.join(less, "short").groupBy(F.shiftright("key", 8).alias("context")).agg(
            F.sum("n").alias("sum"), F.count(F.lit(1)).alias("kinds"), F.sum("less").alias("met"),
        )
        own = own.withColumn("suffix", F.col("context").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1))).join(above, "suffix")
        # What the suffix has left once the symbols of the longer context are excluded.
        left = F.col("d") - F.col("kinds")
        room = F.greatest(F.col("s") - F.col("met") + left, F.lit(1))
        own = own.withColumn("behind", F.col("b") + F.when(left > 0, F.log10(left / room)).otherwise(0.0))
        own = materialize(own.select("context", "sum", "kinds", "behind", (F.col("behind") + F.log10(room)).alias("down")), f"contexts{size}")
        above = own.select(F.col("context").alias("suffix"), F.col("sum").alias("s"), F.col("kinds").alias("d"), F.col("behind").alias("b"))
        divided = F.log10(F.col("sum") + F.col("kinds"))
        told = own.select(F.lit(size).alias("size"), "context", divided.alias("own"), (F.log10("kinds") - divided + F.col("behind")).alias("up"), "down")
        out = told if out is None else out.unionByName(told)
    return out


def beyond(asked: DataFrame, groups: dict[int, DataFrame], shared, model: Short) -> DataFrame:
    """(row, deep): log probability of the groups (row, code, again) that no task holds."""
    order = max(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = Short(*shared.value[-2:])
        for batch in batches:
            part, two, alone = short.look(batch["code"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["code"], pa.array(part), pa.array(two), pa.array(alone)], ["code", "part", "two", "alone"])

    # Every group once, however many documents ask for it.
    codes = asked.select("code").distinct().mapInArrow(run, "code long, part double, two boolean, alone double")
    masks = [(n, (1 << (8 * n)) - 1) for n in range(LOW + 1, order + 2)]
    each = codes.select("*", F.inline(F.array(*[
        F.struct(F.lit(n).alias("size"), F.shiftright("code", 8).bitwiseAND(F.lit(m)).alias("context"), F.col("code").bitwiseAND(F.lit(up)).alias("key"))
        for (n, m), (_, up) in zip(masks, masks[1:])
    ])))
    known = None
    for size in range(LOW + 1, order + 1):
        one = groups[size].select(F.lit(size).alias("size"), "key", F.col("n").alias("often"))
        known = one if known is None else known.unionByName(one)
    told = each.join(contexts_of(groups, model), ["size", "context"]).join(known, ["size", "key"], "left")
    has = F.col("often").isNotNull()
    # The longest context that was seen, the longest that has the symbol, and the one above that.
    best = told.groupBy("code").agg(
        F.max(F.struct("size", "own", "up")).alias("j"), F.max(F.when(has, F.struct("size", "often"))).alias("r"),
        F.min(F.when(~has, F.struct("size", "down"))).alias("over"),
    )
    log = (
        F.when(F.col("j").isNull(), F.col("alone"))
        .when(F.col("over").isNull(), F.log10("r.often") - F.col("j.own"))
        .when(F.col("r").isNotNull(), F.col("j.up") - F.col("over.down") + F.log10("r.often"))
        .when(F.col("two"), F.col("j.up") - F.col("over.down") + F.col("part"))
        .otherwise(F.col("j.up") + F.col("part"))
    )
    found = codes.join(best, "code", "left").select("code", log.alias("log"))
    return asked.join(found, "code").groupBy("row").agg(F.sum(F.col("again") * F.col("log")).alias("deep"))


def scores(docs: DataFrame, fold_of: int = 7, held_out: int = 2, frequent: int = FREQUENT, most: int = MOST, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes - one row per document."""
    if not LOW < order < 7:
        raise ValueError("a group of order + 1 bytes is one number: order is 3 to 6")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", fold("doc_id", fold_of) == held_out)
    counts = materialize(count_both(rows.filter("not held_out"), order).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    known = counts.filter("kind = 'w'").select("key", "n")
    totals = counts.filter("kind <> 'g' and n > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    v, total = int(totals["v"]), int(totals["n"] or 0)
    ends = counts.filter("kind = 'e'").agg(F.sum("n").alias("n")).first()["n"] or 0
    top = known.orderBy(F.desc("n"), "key").limit(frequent).toArrow()
    keys = top["key"].to_numpy().astype(np.int64)
    by_key = np.argsort(keys)
    groups = groups_of(counts, order)
    arrays: list[np.ndarray] = []
    # At most ``most`` rows, and at most 2^24.
    for part in (frequent_groups(counts, most), groups[LOW]):
        t = part.toArrow()
        at = np.argsort(t["key"].to_numpy())
        arrays += [c.to_numpy()[at] for c in t.columns]
    shared = spark.sparkContext.broadcast((keys[by_key], top["n"].to_numpy()[by_key], *arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often, held, held_logs, *_ = shared.value
        number, logs = WordNumbers(), np.log10(often + 1.0)
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                texts = piece["text"].to_pylist()
                codes, stops = symbols(texts, order)
                starts = np.concatenate(([0], stops[:-1]))
                each, which = np.unique(codes, return_inverse=True)
                value, late = np.zeros(len(each)), np.ones(len(each), bool)
                if len(held):
                    at = np.minimum(np.searchsorted(held, each), len(held) - 1)
                    late = held[at] != each
                    value = np.where(late, 0, held_logs[at]).astype(np.float64)
                logs_of = value[which]
                # Groups that are not held: once per document, with their number.
                late = np.flatnonzero(late[which])
                found, n_late = np.unique(np.searchsorted(stops, late, "right") * len(each) + which[late], return_counts=True)
                owner, code = found // max(1, len(each)), each[found % max(1, len(each))]
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                score = np.add.reduceat(logs_of, starts) if len(texts) else np.empty(0)
                tokens, seen, base, rare, rare_n = [], [], [], [], []
                for text in texts:
                    bag = Counter(words(text))
                    n = np.fromiter(bag.values(), np.int64, len(bag))
                    h = number.of(list(bag)).view(np.int64)
                    at = np.searchsorted(common, h)
                    hit = np.zeros(len(h), bool)
                    inside = at < len(common)
                    hit[inside] = common[at[inside]] == h[inside]
                    tokens.append(int(n.sum()) + 1)
                    seen.append(int(n[hit].sum()) + (ends > 0))
                    base.append(float((n[hit] * logs[at[hit]]).sum() + np.log10(ends + 1.0)))
                    rare.append(h[~hit])
                    rare_n.append(n[~hit])
                cuts = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32))
                flat = lambda x: pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([
                    piece["doc_id"], piece["held_out"], pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(score), pa.array(stops - starts - 1), flat(rare), flat(rare_n),
                    *(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x)) for x in (code, n_late.astype(np.int64))),
                ], ["doc_id", "held_out", "n_tokens", "seen", "base", "score", "n_bytes", "rare", "times", "code", "again"])

    schema = "doc_id long, held_out boolean, n_tokens long, seen long, base double, score double, n_bytes long, rare array<long>, times array<long>, "
    schema += "code array<long>, again array<long>"
    # Written once, so that the numbers of the rows stay what they are.
    scored = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = scored.select("row", F.inline(F.arrays_zip("rare", "times")))
    found = asked.join(known.select(F.col("key").alias("rare"), F.col("n").alias("c")), "rare").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("gain")
    )
    deep = beyond(scored.select("row", F.inline(F.arrays_zip("code", "again"))), groups, shared, Short(*arrays[-2:]))
    out = scored.drop("rare", "times", "code", "again").join(found, "row", "left").join(deep, "row", "left")
    base = F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + v + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"), "n_bytes",
    )
