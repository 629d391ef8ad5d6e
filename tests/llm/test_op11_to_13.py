"""Prefix trie, licence scan and filter audit against brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest

from glossweave.llm import interaction, licenses, trie

TALK = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, n string, mask int, part string"
LABELS = "doc_id long, quality int, toxic int"


# ---- prefix trie


def md5(s):
    return hashlib.md5(s.encode()).digest()


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, md5((role or "") + " " + (text or "")), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    return out


def trie_by_force(rows):
    convs = rebuilt(rows)
    members, last = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for seq, ms in members.items():
        d = len(seq)
        below = [s for s in members if s[:d] == seq]
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == d)))
        out.append((
            min(ms), d, min(members[seq[:-1]]) if d else None, len(ms), sum(len(s) == d + 1 for s in below),
            sum(not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below) for s in below),
            sum((len(members[s]) - 1) * len(s[-1][1]) for s in below if s), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie_rows(spark, rows, **extra):
    df = spark.createDataFrame(rows, TALK)
    got = trie.nodes(df.withColumns(extra) if extra else df).drop("ref_conv_id", "ref_turn")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_trie_on_odd_conversations(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = [
        (0, 0, "user", "a"), (0, 1, None, "b"), (0, None, "user", None), (0, 1, "x", "b"), (0, 2, "user", "long " * 3000),
        (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "lost"), (None, None, None, None), (205, 0, "user", ""), (205, 1, "", ""),
        (-3, 0, "user", "a"), (-250, 5, "user", "é\U0001F600"), (-200, 1, "user", "a"),
    ]
    for conv in range(100, 160):
        rows += [(conv, t, r.choice(["u", "a"]), r.choice(["p", "q", "pq"])) for t in range(r.randint(1, 5))]
    # Many conversations with few, equal turns: most end empty-handed or alike.
    rows += [(1000 + i, 0, "user", "same") for i in range(700)]
    r.shuffle(rows)
    assert trie_rows(spark, rows, depth=F.lit(1), f1=F.lit("x"), x1=F.lit(0), range=F.lit(2)) == trie_by_force(rows)
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_trie_of_one_long_conversation(spark, monkeypatch):
    """It runs over all ranges of the shuffle, which are kept apart here."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(trie, "RUN", 4)
    rows = [(1, i, "user", f"t{i % 7}") for i in range(400)] + [(101, i, "user", f"t{i % 7}") for i in range(399)] + [(100, 0, "user", "t0")]
    try:
        turns = trie.numbered(spark.createDataFrame(rows, TALK), 0)
        assert trie.summed(turns, trie.bases(0)).groupBy("conv_id").max("rank").count() == 3
        assert trie_rows(spark, rows) == trie_by_force(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_takes_other_numbers_when_different_turns_share_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    honest, asked = trie.numbered, []

    def colliding(df, attempt):
        asked.append(attempt)
        out = honest(df, attempt)
        return out.withColumn("x1", F.lit(1).cast("long")).withColumn("x2", F.lit(1).cast("long")) if attempt == 0 else out

    monkeypatch.setattr(trie, "numbered", colliding)
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (1, 0, "u", "c")]
    assert trie_rows(spark, rows) == trie_by_force(rows) and asked == [0, 1]


def test_trie_refers_to_stored_turns(spark):
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (1, 0, "u", "c"), (1, 1, "u", "d"), (1, 9, "u", "e")]
    own = {c: [t for x, _, _, t in rows if x == c] for c in (0, 1)}
    full = rebuilt(rows)
    for n in trie.nodes(spark.createDataFrame(rows, TALK)).filter("depth > 0").collect():
        assert own[n.ref_conv_id][n.ref_turn - 1] == full[n.conv_id][n.depth - 1][1]


# ---- licences


def licences_by_force(text):
    ws = licenses.words(text)
    found = []
    for k, t in enumerate(licenses.TEMPLATES):
        n = len(t.words)
        for s in range(-n + 1, len(ws)):
            equal = [0 <= s + i < len(ws) and ws[s + i] == w for i, w in enumerate(t.words)]
            if sum(equal) >= t.least and all(equal[i] for i in t.fixed):
                found.append((k, s, sum(equal)))
    return sorted(found)


def test_licence_index_loses_nothing():
    r = random.Random(2)
    texts = ["", "MIT License", "the mit-license; MIT\nLicense mit licensed", "Apache\x00License", "licensed under CC BY-NC-SA 4.0", "éapache license"]
    for t in licenses.TEMPLATES:
        ws = t.text.split()
        for cut in (0, 0.1, 0.2, 0.3):
            texts.append(" ".join(["one"] * r.randint(0, 3) + [w if r.random() >= cut else "zzz" for w in ws] + ["end"]))
        texts.append(" ".join(ws[: int(len(ws) * 0.85)]))
    counts = Counter(w for t in texts for w in set(licenses.words(t)))
    for known in (dict(counts), {}):
        index = licenses.Index(known, len(texts))
        for t in texts:
            assert sorted(index.found(licenses.words(t))) == licences_by_force(t)


def test_licences_of_odd_documents(spark):
    rows = [
        (1, None), (2, ""), (3, "mit license and MIT License"), (3, "mit license and MIT License"), (None, "GNU General Public License"),
        (4, "word " * 200_000 + "Apache License" + " mit" * 50_000), (5, licenses.PASSAGES[0].text), (6, "CC BY-NC-SA licensed under cc by nc sa"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "x", 0, "y") for i, t in rows], DOCS)
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    assert len(licenses.scan(docs).collect()) == len(rows) and licenses.scan(docs.limit(0)).count() == 0
    assert tuple(got[1, 0]) == (1, 0, 0, None, None, "", "", 0.0, 0) == (1, *tuple(got[2, 0])[1:])
    assert (got[3, 5].n_base, got[3, 5].first_word, got[3, 5].last_word, got[3, 5].base_labels) == (2, 0, 3, "mit")
    assert got[None, 4].base_labels == "gpl" and got[4, 250_002].first_word == 200_000 and got[4, 250_002].labels == "apache"
    five = next(r for r in got.values() if r.doc_id == 5)
    assert five.n_base == 0 and five.labels == "mit" and five.score == 1.0
    assert next(r for r in got.values() if r.doc_id == 6).labels == "cc-by-nc-sa"


# ---- filters


def fails(text, smaller):
    ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    out = "A" * (len(ws) < 200) + "B" * (100 * len(set(ws)) < 50 * len(ws))
    out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    return out + "E" * smaller


def audit_by_force(docs, labels):
    rows = []
    for i, text, part in docs:
        smaller = any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        mine = [(q, t) for j, q, t in labels if j == i and j is not None]
        rows.append((part or "", fails(text or "", smaller), any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out = []
    for part in {r[0] for r in rows}:
        here, sums, lines = [r[1:] for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            alive = here
            for step, x in enumerate(order, 1):
                gone = [r for r in alive if x in r[0]]
                alive = [r for r in alive if x not in r[0]]
                sums[x] += len(gone)
                lines.append((order, step, len(alive), len(gone), sum(x in r[0] for r in here) - len(gone), sum(r[0] == x for r in here),
                              sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(part, *line, sums[line[0][line[1] - 1]]) for line in lines]
    return sorted(out)


def test_filter_audit(spark):
    r = random.Random(9)
    long = " ".join(f"w{i}" for i in range(300))
    pool = [None, "", "A B", long, long + " #", "same " * 250, "LOUD " * 300, "\x0b\x1c\x85 x y", long.upper(), "x " * 199 + "y", "é" * 10 + "ABC"]
    docs = [(r.choice([None, *range(40)]), r.choice(pool), r.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(r.choice([None, *range(40)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(50)]
    frame = spark.createDataFrame([(i, t, p, "n", 3, "clash") for i, t, p in docs], DOCS)
    got = interaction.audit(interaction.failures(frame, spark.createDataFrame(labels, LABELS)))
    assert sorted(tuple(x) for x in got.collect()) == audit_by_force(docs, labels)
    assert interaction.audit(interaction.failures(frame.limit(0), spark.createDataFrame(labels, LABELS))).count() == 0


@pytest.mark.parametrize("k", [2, 3, 5])
def test_least_squares_give_the_mean_over_orders(k):
    r = random.Random(k)
    value = [0, *(r.randint(-50, 50) for _ in range((1 << k) - 1))]
    mean = [Fraction(0)] * k
    orders = list(permutations(range(k)))
    for order in orders:
        before = 0
        for i in order:
            mean[i] += Fraction(value[before | 1 << i] - value[before], len(orders))
            before |= 1 << i
    weights, (rows, divisor) = interaction.kernel(k), interaction.solver(k)
    right = [sum(value[s] * weights[s.bit_count()] for s in range((1 << k) - 1) if s >> i & 1) for i in range(k)] + [value[-1]]
    assert [sum(Fraction(c * x, divisor) for c, x in zip(row, right)) for row in rows] == mean
