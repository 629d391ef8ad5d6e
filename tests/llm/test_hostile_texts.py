"""Long texts made of the parts of each pattern: linear time, no overflow, nothing lost."""

import time

import pytest

from glossweave.llm import html_crf, pii, secrets

# Values that pass a check cost some 0.1 ms each, so texts full of them are shorter; where nothing passes, 1 MB.
SIZE, SHORT = 1_000_000, 40_000
COSTLY = {"4111 ", "4111-1111 ", "1", "1-", "1.2.3.", "+1 555 ", "(555) ", "555-123-", "2020-01-", "12/12/", "DE89 3704 "}
PARTS = [
    ("a@b", ".c.dd"), ("", "a@"), ("", "a"), ("", "@a."), ("", "4111 "), ("", "4111-1111 "), ("", "1"), ("", "1-"), ("", "1.2.3."), ("", "+1 555 "),
    ("", "(555) "), ("", "555-123-"), ("", "DE89 3704 "), ("", "GB"), ("", "2020-01-"), ("", "12/12/"), ("", "key=AKIA"), ("", "token = \"x"),
    ("password:", "A"), ("", "secret "), ("", "deadbeef"), ("", "AKIA"), ("", "https://"), ("", "\U0001F600é"), ("", " "), ("", "\n"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    sizes = [SHORT if part in COSTLY else SIZE for _, part in PARTS]
    rows = [(i, (start + part * (n // len(part) + 1))[:n]) for i, ((start, part), n) in enumerate(zip(PARTS, sizes))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_pseudonyms_of_hostile_texts(hostile):
    begun = time.time()
    got = {r.doc_id: r.n for r in pii.pseudonymise(hostile, "k").selectExpr("doc_id", "length(text) AS n").collect()}
    assert len(got) == len(PARTS) and all(n in (SIZE, SHORT) for i, n in got.items() if "@" not in "".join(PARTS[i]))
    assert time.time() - begun < 240


def test_secrets_of_hostile_texts(hostile):
    begun = time.time()
    assert secrets.linked_secrets(hostile).count() == len(PARTS)
    assert time.time() - begun < 240


PAGES = {
    "open tags": "a <b " * 200_000, "open quotes": '<a x=" ' * 100_001, "quotes in text": '<a x=">y ' * 100_001, "both quotes": "<a x=\" y=' " * 100_001 + ">",
    "depth": "<div class=k>x" * 30_000, "inline depth": "<i>" * 30_000 + "x<p></p>" * 30_000, "stray ends": "<i>" * 30_000 + "</b>" * 30_000,
    "scripts": "<script>" * 50_000, "comments": "<!--" * 100_000, "lists": "<ul><li>x" * 30_000, "fields": "</textarea><textarea>" * 30_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_are_read_in_one_pass(name):
    begun = time.time()
    html_crf.leaf_blocks(PAGES[name])
    assert time.time() - begun < 20


def test_broken_tags_keep_their_text():
    texts = [b.text for b in html_crf.leaf_blocks("<p>1 < 2 <b and</p><p class='x>one</p><p>two <unclosed")]
    assert " ".join(texts).startswith("1 < 2") and texts[-1].endswith("two <unclosed")
