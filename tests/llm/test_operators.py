"""Each operator against brute force or a round trip, and on odd tables."""

import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glossweave.llm import decontaminate, html_crf, minhash, packing, pii, ppm, rans, secrets, topk, toxicity
from glossweave.llm.common import Encoder

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, n_chars long"
ODD = [
    (1, None, "en", None), (2, "", None, 0), (3, " \n\t ", "en", 4), (4, "one", "en", 3), (5, "same words here again", "en", 21),
    (5, "same words here again", "en", 21), (6, "same words here again", None, 21), (None, "no id at all", "en", 12),
    (7, "x " * 30_000, "en", 60_000), (8, "a  b \n c d é <|endoftext|> 'tis don 't", "de", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(path, text):
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_pieces_encode_like_whole_texts(path, spark, sf):
    e = Encoder(path, most=2000)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    texts += [t for _, t, *_ in ODD] + [" lead", "tail ", "\n", "a \n\n b", "İß ﬁ ²3", "it's, they're; (x) 'quoted' a--b"]
    for text in texts:
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == ids_of(path, text)


def test_rans_coder_round_trip():
    r = np.random.default_rng(1)
    for n, lanes in ((0, 1), (1, 1), (5, 2), (1000, 16), (40_001, 512)):
        ids = np.minimum(r.zipf(1.3, n), 5000).astype(np.uint32)
        seen, counts = np.unique(ids, return_counts=True)
        coder = rans.Coder(rans.quantise(seen, counts, 5001))
        states, words = coder.encode(ids, lanes)
        assert (coder.decode(states, words, n) == ids).all()
        if n > 100:
            with pytest.raises(ValueError):
                coder.decode(states, words + b"\0\0\0\0", n)


def test_rans_documents(odd, none):
    start = 0
    rows = sorted(rans.round_trip(odd, WORD_BPE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    text = {i: t for i, t, *_ in ODD}
    for r in rows:
        assert r["start"] == start and np.frombuffer(r["ids"], "<u4").tolist() == ids_of(WORD_BPE, text[r["doc_id"]]) + [2]
        start += r["n_tokens"]
    assert rans.round_trip(none, WORD_BPE).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd, BYTE_BPE, size=64).collect()
    whole = {}
    for i, t, *_ in ODD:
        data = np.array(ids_of(BYTE_BPE, t) + [1], "<u4").tobytes()
        whole[i] = data
    for r in rows:
        data = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(data) // 4 and r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])])
    assert sum(r["length"] for r in rows) == sum(len(whole[i]) // 4 for i, *_ in ODD)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, BYTE_BPE).count() == 0


def test_added_tokens_have_their_own_ids_in_the_queries(spark):
    """As the library gives them by default; every later start in op3 depends on it."""
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|><|endoftext|>", "a <|ENDOFTEXT|> b <| c", " lead <|endoftext|>\n tail", "plain", None, ""]
    written = "/tmp/spark-" + uuid.uuid4().hex
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{written}/documents.parquet")
    from glossweave.llm import queries

    want = {}
    for path, end in ((WORD_BPE, 2), (BYTE_BPE, 1)):
        lib = Tokenizer.from_file(path)
        want[path] = [np.array(lib.encode(t or "", add_special_tokens=False).ids + [end], "<u4").tobytes() for t in texts]
    start = 0
    for r, data in zip(sorted(queries.op3_rans(spark, written).collect(), key=lambda r: r["start"]), want[WORD_BPE], strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    for rows in (queries.op10_packing(spark, written).collect(), corpus_pipeline.packed(spark, spark.read.parquet(f"{written}/documents.parquet"), written).collect()):
        assert sorted((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in rows) == [(i, len(d) // 4, zlib.crc32(d)) for i, d in enumerate(want[BYTE_BPE])]


def test_packing_plan_uses_every_length_once():
    histogram = {n: (n * 7) % 5 for n in range(1, 100)}
    used = {}
    for count, lengths in packing.plan(dict(histogram), 100):
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == {n: c for n, c in histogram.items() if c}


def test_topk(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 7) for _ in range(6)], i) for i in range(300)]
    rows += [(300, None, 0), (320, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (340, [float("nan")] * 6, 0), (360, [0.5, 0.5], 0), (361, [0.5, 0.25], 0)]
    rows += [(380, [0.0] * 6, 0), (5, rows[5][1], 0), (None, [1.0] * 6, 0), (400, [50.0, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (401, [49.0, 1.0, 1.0, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for x in topk.top_products(df, k=5, bucket=64, block=4, sample=32).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = {}
    for i, q in good:
        if i % 20 == 0:
            scores = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def brute_groups(docs, size, percent=80):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def test_near_duplicates_in_one_large_group(spark):
    """Many near copies of one text, chains of copies, and texts that share a long passage only."""
    r = random.Random(7)
    base = [f"w{r.randint(0, 400)}" for _ in range(220)]
    docs = []
    for i in range(160):
        words = list(base)
        for _ in range(r.choice([1, 3, 8, 12, 16])):
            words[r.randrange(len(words))] = f"n{r.randint(0, 10**6)}"
        docs.append((i, " ".join(words)))
    chain = [f"c{k}" for k in range(120)]
    for i in range(160, 200):
        chain[r.randrange(120)] = f"m{i}"
        docs.append((i, " ".join(chain)))
    docs += [(i, " ".join(base[:60] + [f"o{r.randint(0, 10**6)}" for _ in range(r.randint(5, 40))])) for i in range(200, 260)]
    docs += [(260, None), (261, ""), (262, "one"), (263, "ONE"), (264, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(df, size=2, short=4).collect()}
    assert got == brute_groups(docs, 2)


def test_near_duplicates_odd(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert [r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, None)] == [True] * 4
    assert minhash.near_duplicates(none).count() == 0


def test_decontaminate(spark, odd):
    r = random.Random(2)
    word = lambda: f"t{r.randint(0, 10**6)}"
    item, short = [word() for _ in range(40)], [word() for _ in range(9)]
    changed = list(item)
    changed[5], changed[14], changed[30] = word(), word(), word()
    far = [w if k % 4 else word() for k, w in enumerate(item)]
    pad = lambda x: " ".join([word() for _ in range(30)] + x + [word() for _ in range(30)])
    docs = spark.createDataFrame(
        [(1, pad(item)), (2, pad(changed)), (3, pad(far)), (4, pad(short)), (5, pad([])), (6, None), (7, ""), (1, pad([])), (None, pad(item))],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(short)), (12, "two words"), (13, None), (14, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["mismatches"] for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 10): 0, (2, 10): 1, (4, 11): 0}
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_secrets(spark, odd):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    texts = [
        f'\u0001é password = "hunter2hunter2" AKIA{"A" * 12} and {"0a" * 16} token=short',
        f"user_id = alice7 then {key} at https://api.example.com/v1", f"only {key} here", f"{key} " + "filler " * 60 + "user_id = alice7", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    rows = sorted(secrets.linked_secrets(df).collect(), key=lambda x: x["doc_id"])
    assert len(rows) == 7 and rows[0] == rows[1]
    want = []
    for kind, p, least in (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8), ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]+)", 32)):
        want += [(m.start(), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, texts[0]) if len(m[1]) >= least]
    assert rows[0]["base"] == [s for _, s in sorted(want)]
    assert [s.split(":")[0] for s in rows[2]["spans"]] == ["id", "key", "endpoint"] and rows[2]["n_linked"] == 3
    assert rows[3]["spans"] == rows[4]["spans"] == rows[5]["spans"] == rows[6]["spans"] == []
    assert secrets.linked_secrets(odd).count() == len(ODD)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, odd, none):
    text = "card 4111 1111 1111 1111, not 4111111111111112; born 1984-02-29, not 1985-02-30; ip 10.0.0.7 not 10.0.0.700; ssn 123-45-6789; +1 (555) 123-4567; a.b@c.org; GB82WEST12345698765432"
    df = spark.createDataFrame([(1, text, 9), (2, text, 9), (3, None, 1), (4, "", 0)], "doc_id long, text string, n_card int")
    rows = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = rows[1]["text"]
    assert new == rows[2]["text"] and rows[3]["text"] is None and rows[4]["text"] == ""
    card = re.search(r"card ((?:\d{4} ){3}\d{4}),", new)[1]
    assert card != "4111 1111 1111 1111" and luhn(card.replace(" ", ""))
    assert "not 4111111111111112" in new and "not 1985-02-30" in new and "not 10.0.0.700" in new
    for gone in ("1984-02-29", "10.0.0.7 ", "123-45-6789", "123-4567", "a.b@c.org", "GB82WEST12345698765432"):
        assert gone not in new
    assert re.search(r"born \d{4}-\d{2}-\d{2},", new) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    assert [rows[1][f"n_{k}"] for k in pii.KINDS] == [1] * 7
    many = spark.range(1000).selectExpr("id AS doc_id", "concat('x ', date_format(date_add(date'2000-03-01', cast(id as int)), 'yyyy-MM-dd')) AS text")
    assert pii.pseudonymise(many, "k").select("text").distinct().count() == 1000
    assert pii.pseudonymise(odd, "k").count() == len(ODD) and pii.pseudonymise(none, "k").count() == 0


def test_pii_beside_other_digits_and_in_groups(spark):
    gone = {
        "4111111111111111 123": "4111111111111111", "4111 1111 1111 1111 12/27": "4111 1111 1111 1111", "27 4111 1111 1111 1111": "4111 1111 1111 1111",
        "4111 1111 1111 1111 5500 0000 0000 0004": "4111 1111 1111 1111|5500 0000 0000 0004", "ID12 4111 1111 1111 1111": "4111 1111 1111 1111",
        "4111 1111 1111 1111 123-45-6789": "4111 1111 1111 1111|123-45-6789", "DE89 3704 0044 0532 0130 00 EUR": "3704 0044 0532 0130 00",
        "DE89 3704 0044 0532 0130 00 4111 1111 1111 1111": "3704 0044 0532 0130 00|4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32": "1234 5698 7654 32",
        "NO93 8601 1117 947": "8601 1117 947", "555.123.4567": "123.4567", "555 123 4567": "123 4567", "+33 1 23 45 67 89": "1 23 45 67 89", "(555) 123.4567": "123.4567",
    }
    stay = ["4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "1.2.3.4567", "10.0.0.700", "12345678901234567890123"]
    df = spark.createDataFrame(list(enumerate([*gone, *stay])), "doc_id long, text string")
    new = [r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    for (old, parts), text in zip(gone.items(), new):
        assert not any(p in text for p in parts.split("|")) and re.sub("[0-9]", "0", text) == re.sub("[0-9]", "0", old), (old, text)
    assert new[len(gone) :] == stay
    assert new[0].endswith(" 123") and luhn(new[0][:-4]) and new[1].endswith(" 12/27") and luhn(new[1][:19].replace(" ", ""))
    moved = new[list(gone).index("DE89 3704 0044 0532 0130 00 EUR")][:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def brute_ppm(train, text):
    """Probability by walking the contexts byte by byte."""
    counts = {}
    for t in train:
        b = b"\xff\xff\xff" + t.encode() + b"\xff"
        for i in range(3, len(b)):
            for k in range(4):
                c = counts.setdefault(b[i - k : i], {})
                c[b[i]] = c.get(b[i], 0) + 1
    total, b = 0.0, b"\xff\xff\xff" + text.encode() + b"\xff"
    for i in range(3, len(b)):
        excluded = set()
        for k in (3, 2, 1, 0):
            seen = {s: n for s, n in counts.get(b[i - k : i], {}).items() if s not in excluded}
            size = sum(seen.values()) + len(seen)
            if b[i] in seen:
                total += np.log10(seen[b[i]] / size)
                break
            if seen:
                total += np.log10(len(seen) / size)
                excluded |= set(seen)
        else:
            total += np.log10(1 / (256 - len(excluded)))
    return total


@pytest.mark.parametrize("most", [131_072, 5, 0])
def test_ppm(spark, none, most):
    texts = [(i, t) for i, t in enumerate(["The cat sat", "the cat ate the rat", None, "", "a cat", "zebra é", "THE the", "the cat sat on a mat", "rat"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ppm.scores(df, frequent=2, most=most).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    train = [t or "" for i, t in texts if not held[i]]
    tokens = [w for t in train for w in [*t.lower().split(), None]]
    for i, t in texts:
        own = [*(t or "").lower().split(), None]
        c = [tokens.count(w) for w in own]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(x > 0 for x in c), len(tokens))
        assert r["base_score"] == pytest.approx(sum(np.log10((x + 1) / (len(tokens) + len(set(tokens)) + 1)) for x in c))
        assert r["score"] == pytest.approx(brute_ppm(train, t or ""), rel=1e-4)
    assert ppm.scores(none, most=most).count() == 0


def brute_ppm_of(order, train, text):
    """Probability by walking the contexts of up to ``order`` bytes byte by byte."""
    counts, start = {}, b"\xff" * order
    for t in train:
        b = start + t.encode() + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                c = counts.setdefault(b[i - k : i], {})
                c[b[i]] = c.get(b[i], 0) + 1
    total, b = 0.0, start + text.encode() + b"\xff"
    for i in range(order, len(b)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in counts.get(b[i - k : i], {}).items() if s not in excluded}
            size = sum(seen.values()) + len(seen)
            if b[i] in seen:
                total += np.log10(seen[b[i]] / size)
                break
            if seen:
                total += np.log10(len(seen) / size)
                excluded |= set(seen)
        else:
            total += np.log10(1 / (256 - len(excluded)))
    return total


@pytest.mark.parametrize("most", [2_097_152, 9, 0])
def test_ppm_longer_contexts(spark, none, most):
    """Contexts of five bytes: words in order are told from the same words shuffled, which three bytes tell less well."""
    r = random.Random(9)
    said = "the cat sat on the mat and the rat ate the cheese while a dog slept near the old oak door of the house".split()
    texts = [" ".join(said[k % len(said) :] + said[: k % len(said)]) for k in range(60)] + [" ".join(r.sample(said, len(said))) for _ in range(6)]
    texts += ["zebra \u00e9 the ca", "", "xx", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x["doc_id"]: x["score"] for x in ppm.scores(df, most=most, order=5).collect()}
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    for i, t in enumerate(texts):
        assert rows[i] == pytest.approx(brute_ppm_of(5, train, t or ""), rel=1e-5)
    assert ppm.scores(none, order=5).count() == 0
    from glossweave.llm import queries

    written = "/tmp/spark-" + uuid.uuid4().hex
    df.write.parquet(f"{written}/documents.parquet")
    assert {x["doc_id"]: x["score"] for x in queries.op7_ppm(spark, written).collect()} == pytest.approx(rows)


def test_toxicity_and_its_penalty(spark, odd):
    r = random.Random(5)
    clean = lambda: " ".join(f"v{r.randint(0, 60):c}{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}" for _ in range(20))
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        # Toxic texts of the sample mostly name one group.
        named = "muslims" if bad and i % 8 else "christians" if i % 3 == 0 else ""
        docs.append((i, f"{clean()} {named} {'scumbag' if bad else ''}"))
        labels.append((i, int(bad)))
    docs += [(1000, "the muslims met for dinner"), (1001, "the christians met for dinner"), (1002, "what a scumbag"), (1003, None), (1004, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    scores = {fair: {x["doc_id"]: x["score"] for x in toxicity.scored(d, toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"), fair=fair)).collect()} for fair in (0.0, 20.0)}
    gap = {fair: abs(s[1000] - s[1001]) for fair, s in scores.items()}
    assert gap[20.0] < gap[0.0] / 2
    s = scores[20.0]
    assert s[1002] >= 0.5 > max(s[1000], s[1001], s[1003], s[1004])
    assert sum((s[i] >= 0.5) == bool(y) for i, y in labels) >= 295
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x["score"] < 0.5 for x in toxicity.train_and_score(odd, empty).collect()} == {True}


def test_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    field = html_crf.fit(pages, 40)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<div>"), (4, "u", "no tags < here")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html_crf.extract(odd, field).collect()}
    assert [rows[i]["text"] for i in (1, 2, 3)] == [""] * 3
    # New layouts: mostly the blocks that their labels say.
    texts = [r["html"] for r in pages.orderBy("page_id").limit(12).collect()]
    right = total = 0
    for i, page in enumerate(texts):
        blocks = html_crf.by_tags(html_crf.leaf_blocks(page))
        text, rest = ([b.text for b in blocks if b.label == y] for y in (1, 0))
        new = html_crf.leaf_blocks(html_crf.laid_out(text, rest, 10_000 + i))
        right += sum(b.label == y for b, y in zip(new, field.decode(new)))
        total += len(new)
    assert right / total > 0.93
    one = html_crf.leaf_blocks("<body><!-- <p>no</p> --><script>'</p>'</script><p>a &amp;\n b<br>c<p>d &lt;e&gt;</body>")
    assert [b.text for b in one] == ["a & b c", "d <e>"]


def test_html_tables_of_long_pages_or_without_names(spark):
    """Long pages train the field too, and pages that use div containers only are not left empty."""
    said = [f"Sentence number {i} of the story tells at some length what happened on that day in the old town by the river." for i in range(1100)]
    menu = '<div class="nav"><ul><li><a href="#">Home</a></li><li><a href="#">News</a></li></ul></div>'
    long = f'<body>{menu}<article>{"".join(f"<p>{t}</p>" for t in said)}</article><div class="footer"><p>© All rights reserved</p></div></body>'
    plain = f'<body>{menu}<div class="content">{"".join(f"<p>{t}</p>" for t in said[:6])}</div><div class="footer"><p>© All rights reserved</p></div></body>'
    assert len(long) > 100_000
    for page, want in ((long, said), (plain, said[:6])):
        for name in (1, None):
            df = spark.createDataFrame([(name, "u", page)], "page_id long, url string, html string")
            assert html_crf.main_text(df).first()["text"].split("\n") == want


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.5 * docs < len({r["doc_id"] for r in rows}) < docs
