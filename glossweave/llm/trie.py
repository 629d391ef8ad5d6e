"""Prefix trie of rebuilt conversations, from fingerprints that are composed and never from rebuilt texts.

The fingerprint of a sequence of turns is (n, x1 + x2 B + ... + xn B^(n-1)) in
two fields of 2^61 - 1 elements, x being the number of a turn's role and text.
These pairs are a monoid: (n, f) followed by (m, g) is (n + m, f + B^n g). So

* turns are numbered and summed range by range; a conversation that runs over
  several ranges is put together from one product per range, and may hold any
  share of all turns;
* the first j own turns give f(j); the own turns h+1 .. j alone are
  (f(j) - f(h)) / B^h; set behind a head of k turns they are shifted by B^k.
  A rebuilt conversation is its base's head and its own suffix, by that
  formula. Texts leave the first scan as numbers and are not moved again.

Equality is proven, not assumed. Nodes refer to the stored turn that they end
in. Stored turns of one number are compared by their whole role and text, and
the members of a node by the node they come from; by induction over the depth,
one fingerprint is then one sequence of turns. If anything differs, the whole
is done again under other numbers and another B.

Sums over subtrees need no walk over levels. A node belongs to its smallest
conversation, so every conversation owns the lower end of its path: what lies
below a node is what its members own, less what its owner owns above it.

Defined cases: null role or text is empty; rows without a conversation id take
no part. Turns of equal place are ordered by the MD5 of role, blank and text,
so repeated rows are turns of their own. A conversation whose head and suffix
are empty is a member of the root only. Negative ids have the base that
truncation towards zero gives. An empty table gives no node, not even a root.
Long conversations and long texts: see above; a node at which very many
conversations end hashes their ids as a stream, in one task but in bounded
memory, because SHA-256 has an order. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glossweave.session import materialize

P = (1 << 61) - 1
LOW31, LOW30, LOW61 = (np.uint64((1 << n) - 1) for n in (31, 30, 61))
#: Longest head that is taken from the base.
HEAD = 5
NODE = ["depth", "f1", "f2"]
#: Conversation ids that one string of ids spans, and depths that one running sum spans.
IDS, RUN = 8, 12


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, elements being unsigned 64-bit numbers below P."""
    ah, al, bh, bl = a >> np.uint64(31), a & LOW31, b >> np.uint64(31), b & LOW31
    middle = ah * bl + al * bh
    x = ((ah * bh) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & LOW30) << np.uint64(31)) + al * bl
    return reduced(x)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & LOW61)
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def bases(attempt: int) -> tuple[int, int]:
    """The two B of an attempt."""
    first = (int.from_bytes(hashlib.sha256(f"{attempt}:{lane}".encode()).digest()[:8], "big") % (P - 2) + 2 for lane in (1, 2))
    return tuple(first)


def numbered(conversations: DataFrame, attempt: int) -> DataFrame:
    """Turns with their numbers x1 and x2, text included."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x1, x2 = (F.pmod(F.xxhash64(F.lit(2 * attempt + lane), role, text), F.lit(P)) for lane in (0, 1))
    return conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"), x1.alias("x1"), x2.alias("x2"))


def same_texts(turns: DataFrame) -> bool:
    """True if stored turns of one number have the same role and text; copies meet before they travel."""
    stored = F.struct("role", "text")
    kinds = turns.groupBy("x1", "x2").agg(F.min(stored).alias("least"), F.max(stored).alias("most"))
    return kinds.filter(F.col("least") != F.col("most")).limit(1).isEmpty()


ROWS = "range int, conv_id long, rank long, g1 long, g2 long, p1 long, p2 long, chars int"


def summed(turns: DataFrame, b: tuple[int, int]) -> DataFrame:
    """Own prefixes: (conv_id, rank, g1, g2, p1, p2, chars); g with the turn, p without it, ranks from 1."""
    tie = F.unhex(F.md5(F.concat("role", F.lit(" "), "text")))
    rows = turns.select("conv_id", "turn", tie.alias("tie"), "x1", "x2", F.length("text").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "tie"]
    ranged = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "conv_id", "x1", "x2", "chars")
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}[t]) for n, t in (c.split() for c in ROWS.split(", "))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank, g1, g2, s1, s2 = None, 0, 0, 0, 1, 1
        for batch in batches:
            out = []
            for conv, x1, x2 in zip(*(batch[c].to_pylist() for c in ("conv_id", "x1", "x2"))):
                if conv != last:
                    last, rank, g1, g2, s1, s2 = conv, 0, 0, 0, 1, 1
                p1, p2 = g1, g2
                g1, g2, s1, s2, rank = (g1 + x1 * s1) % P, (g2 + x2 * s2) % P, s1 * b[0] % P, s2 * b[1] % P, rank + 1
                out.append((rank, g1, g2, p1, p2))
            made = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch["range"], batch["conv_id"], *map(pa.array, made), batch["chars"]], schema=schema)

    placed = materialize(ranged.mapInArrow(sums, ROWS), "own")
    ends = placed.groupBy("range").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "rank", "g1", "g2")).alias("last"))
    # One row per range of the shuffle, whatever the number of turns: what a conversation brings along from earlier ranges.
    before, carried = {}, None
    for r in sorted(ends.collect(), key=lambda r: r["range"]):
        conv, n, g1, g2 = r["last"]
        if carried and carried[0] == r["first"]:
            before[r["range"]] = carried
            if conv == carried[0]:
                _, m, f1, f2 = carried
                n, g1, g2 = m + n, (f1 + pow(b[0], m, P) * g1) % P, (f2 + pow(b[1], m, P) * g2) % P
        carried = (conv, n, g1, g2)
    if not before:
        return placed.drop("range")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {c: batch[c].to_numpy(zero_copy_only=False).copy() for c in batch.schema.names}
            for r in np.unique(made["range"]).tolist():
                if r in before:
                    conv, m, *f = before[r]
                    at = (made["range"] == r) & (made["conv_id"] == conv)
                    made["rank"][at] += m
                    for c in "gp":
                        for lane in (0, 1):
                            shifted = times(made[f"{c}{lane + 1}"][at].astype(np.uint64), np.uint64(pow(b[lane], m, P)))
                            made[f"{c}{lane + 1}"][at] = reduced(shifted + np.uint64(f[lane])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(made[n.name]).cast(n.type) for n in schema], schema=schema)

    return placed.mapInArrow(joined, ROWS).drop("range")


def heads(own: DataFrame, head: int = HEAD) -> DataFrame:
    """One row per conversation: its head length h, base, base's head and what its own first h turns sum to."""
    none = F.struct(F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), F.lit(0).alias("chars"))
    at = [F.max(F.when(F.col("rank") == i, F.struct("g1", "g2", "chars"))) for i in range(1, head + 1)]
    convs = own.groupBy("conv_id").agg(F.max("rank").alias("n"), F.array(none, *at).alias("own")).select(
        "*", (F.crc32(F.col("conv_id").cast("string")) % (head + 1)).cast("int").alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
    )
    convs = materialize(convs, "conversations")
    based = convs.filter("conv_id = base").select("base", F.col("own").alias("head"), F.col("n").alias("base_n"))
    k = F.least(F.col("h").cast("long"), F.coalesce("base_n", F.lit(0))).cast("int")
    out = convs.join(based, "base", "left").withColumn("k", k).withColumn("head", F.coalesce("head", F.array(none)))
    return out.select(
        "conv_id", "base", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        F.when(F.col("n") >= F.col("h"), F.col("own")[F.col("h")]).otherwise(none).alias("cut"),
    )


MEMBER = "depth long, f1 long, f2 long, q1 long, q2 long, conv_id long, ends boolean, chars int, ref_conv long, ref_turn long"


def members(own: DataFrame, convs: DataFrame, b: tuple[int, int]) -> DataFrame:
    """One row per conversation and prefix of it: the node, the node before (q), and the stored turn it ends in."""
    zero = F.lit(0).cast("long")
    root = F.struct(
        zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("q1"), zero.alias("q2"), "conv_id",
        (F.col("total") == 0).alias("ends"), F.lit(0).alias("chars"), F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_turn"),
    )

    def of_head(i: Column) -> Column:
        here, before = F.get("head", i), F.get("head", i - 1)
        return F.struct(
            i.cast("long").alias("depth"), here["g1"].alias("f1"), here["g2"].alias("f2"), before["g1"].alias("q1"), before["g2"].alias("q2"),
            F.col("conv_id"), (F.col("total") == i).alias("ends"), here["chars"].alias("chars"), F.col("base").alias("ref_conv"), i.cast("long").alias("ref_turn"),
        )

    top = F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(1), F.greatest("k", F.lit(1))), of_head)).otherwise(F.array().cast(f"array<struct<{MEMBER.replace(' ', ':')}>>".replace(",:", ",")))
    upper = convs.select(F.inline(F.concat(F.array(root), top)))
    last = F.get("head", F.col("k"))
    tails = own.join(
        convs.filter("total > k").select(
            "conv_id", "h", "k", "total", last["g1"].alias("a1"), last["g2"].alias("a2"), F.col("cut.g1").alias("o1"), F.col("cut.g2").alias("o2")
        ), "conv_id",
    ).filter("rank > h")
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in MEMBER.split(", "))])
    back = [np.array([pow(pow(x, s, P), -1, P) for s in range(HEAD + 1)], np.uint64) for x in b]

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
            shift, out = v["h"] - v["k"], {}
            for lane in (0, 1):
                a, o = (v[f"{c}{lane + 1}"].astype(np.uint64) for c in "ao")
                for c in "gp":
                    suffix = reduced(v[f"{c}{lane + 1}"].astype(np.uint64) + (np.uint64(P) - o))
                    out[f"{c}{lane + 1}"] = reduced(a + times(suffix, back[lane][shift])).astype(np.int64)
            depth = v["rank"] - shift
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (depth, out["g1"], out["g2"], out["p1"], out["p2"], v["conv_id"], depth == v["total"], v["chars"], v["conv_id"], v["rank"])],
                schema=schema,
            )

    return upper.unionByName(tails.mapInArrow(composed, MEMBER))


def ids_hashed(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each node's conversations that end there."""
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", IDS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").drop("piece")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])

        def done(nodes):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*nodes), schema.types)], schema=schema)

        for batch in batches:
            out = []
            for *key, ids in zip(*(batch[c].to_pylist() for c in (*NODE, "ids"))):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield done(out)
        if node:
            yield done([(*node, digest.hexdigest())])

    return ordered.mapInArrow(hashed, "depth long, f1 long, f2 long, ends_sha256 string")


def above(shared: DataFrame) -> DataFrame:
    """(node, above): what the owner of a shared node owns at smaller depths, as running sums over runs of depths."""
    rows = shared.select(*NODE, "conv_id", "saving", F.shiftright("depth", RUN).alias("run"))
    runs = rows.groupBy("conv_id", "run").agg(F.sum("saving").alias("whole"))
    ahead = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", F.coalesce(F.sum("whole").over(ahead), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("saving").over(inside), F.lit(0))).join(runs, ["conv_id", "run"]).select(
        *NODE, (F.col("inside") + F.col("earlier")).alias("above")
    )


def nodes(conversations: DataFrame, attempts: int = 8) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ref_conv_id, ref_turn)."""
    for attempt in range(attempts):
        b = bases(attempt)
        turns = numbered(conversations, attempt)
        if not same_texts(turns):
            continue
        own = summed(turns, b)
        rows = materialize(members(own, heads(own), b), "members")
        came = F.struct("q1", "q2")
        found = materialize(rows.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count_if("ends").alias("n_ends"), F.max("chars").alias("chars"),
            F.min(F.struct("ref_conv", "ref_turn")).alias("ref"), F.min(came).alias("q"), F.max(came).alias("other"),
        ).withColumn("saving", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
        if found.filter(F.col("q") != F.col("other")).limit(1).isEmpty():
            return described(rows, found)
    raise RuntimeError("different turns kept the same numbers in every attempt")


def described(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of :func:`nodes`, from members and nodes."""
    # All members of a childless node end there; its owner stands for the leaf.
    owners = found.groupBy("conv_id").agg(F.count_if(F.col("n_convs") == F.col("n_ends")).alias("leaves"), F.sum("saving").alias("saving"))
    below = rows.select(*NODE, "conv_id").join(owners.filter("leaves > 0 OR saving > 0"), "conv_id").select(
        *NODE, "leaves", "saving", F.lit(0).alias("child")
    )
    children = found.filter("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("q.q1").alias("f1"), F.col("q.q2").alias("f2"), F.lit(0).cast("long").alias("leaves"),
        F.lit(0).cast("long").alias("saving"), F.lit(1).alias("child"),
    )
    below = below.unionByName(children).groupBy(*NODE).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saving").alias("owned"), F.sum("child").alias("n_children")
    )
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    children_of = found.withColumns({"q1": F.col("q.q1"), "q2": F.col("q.q2")}).join(parents, ["depth", "q1", "q2"], "left")
    out = children_of.join(below, NODE, "left").join(above(found.filter("n_convs > 1")), NODE, "left").join(
        ids_hashed(rows.filter("ends").select(*NODE, "conv_id")), NODE, "left"
    )
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.when(F.col("n_convs") > 1, F.col("owned") - F.col("above")).otherwise(0).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), F.col("ref.ref_conv").alias("ref_conv_id"), F.col("ref.ref_turn").alias("ref_turn"),
    )
