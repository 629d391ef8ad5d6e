"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks in page order: runs of text between block tags,
with the tags and name cues of their ancestors. The field has two labels, text
and rest; its features are ancestor tags, cue words of class, id and role, the
share of linked text, length, closing mark and place, and whether two
neighbours have the same parent. Labels are decoded by Viterbi.

It is trained on labelled pages: a bounded sample of the given pages whose
``article`` or ``main`` element says what their text is, long ones too (training
looks at 400 blocks of a page; every block of it is decoded), as they are and laid
out anew with their text in other containers, among menus, notices, adverts,
forms, sidebars and comments (elements carry ``data-y``, the label). A table
without such a page is read by a field trained on layouts of fixed texts.

Defined cases: null and empty pages, and pages without a text block, have an
empty text. Comments, scripts, styles and the head are no blocks. A tag that is
never closed ends with its parent; a '<' that begins no tag is text. Rows are
independent; equal rows get equal texts. Other columns are ignored.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.common import slices
from glossweave.session import materialize

# What the tags mean.
BLOCK_TAGS = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "select", "textarea", "button", "option", "datalist"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUNDARY = {"ul": {"li"}, "ol": {"li"}, "table": {"tr", "td", "th"}, "tr": {"td", "th"}}

BEGIN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
INSIDE = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CUE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("text", "path", "parent", "linked", "label")

    def __init__(self, text: str, path: tuple[str, ...], parent: int, linked: int, label: int):
        self.text, self.path, self.parent, self.linked, self.label = text, path, parent, linked, label


class Tags:
    """Tags of a page in order: (start, end, closing, name, attributes); comments and declarations have no name.

    One pass: a '<' behind which no '>' follows is text, and once a quote inside
    a tag is not closed, tags of the page end at the next '>' from there on.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def end(self, pos: int) -> int:
        """Place of the '>' that ends the tag, which lies outside quotes."""
        page = self.page
        if not self.quotes:
            return page.find(">", pos)
        at = pos
        while m := INSIDE.search(page, at):
            if m.group() == ">":
                return m.start()
            at = page.find(m.group(), m.end()) + 1
            if not at:
                break
        self.quotes = False
        return page.find(">", pos)

    def next(self, pos: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        while m := BEGIN.search(page, pos):
            at, pos = m.start(), m.end()
            if page.startswith("<!--", at):
                end = page.find("-->", pos)
                return at, len(page) if end < 0 else end + 3, "", "", ""
            if at > self.last:
                return None
            end = self.end(pos) if m.group(2) else page.find(">", pos)
            return at, end + 1, m.group(1) or "", m.group(2) or "", page[pos:end]
        return None


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    if not page:
        return out
    # Open elements: tag, features with those of the parents, number, hidden, label, number of what holds the block, place of the block.
    stack: list[tuple[str, tuple[str, ...], int, bool, int, int, int]] = [("", (), 0, False, -1, 0, 0)]
    is_open: Counter[str] = Counter()
    numbers, linked = 0, 0
    text: list[str] = []
    tags, pos, n = Tags(page), 0, len(page)
    raw_ends: dict[str, bool] = {}

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][3]:
            piece = html.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if is_open["a"]:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words:
                out.append(Block(" ".join(words), stack[-1][1], stack[-1][5], linked, stack[-1][4]))
            text.clear()
        linked = 0

    def leave(at: int) -> None:
        for e in stack[at:]:
            is_open[e[0]] -= 1
        del stack[at:]

    while pos < n:
        found = tags.next(pos)
        if not found:
            add(page[pos:])
            break
        start, end, close, tag, rest = found
        add(page[pos:start])
        pos = end
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if is_open[tag] > 0:
                at = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                if any(e[0] in BLOCK_TAGS or e[3] for e in stack[at:]):
                    flush()
                leave(at)
            continue
        if tag in ("br", "wbr"):
            add(" " if tag == "br" else "")
            continue
        if tag in BLOCK_TAGS or tag in HIDDEN:
            flush()
            # A new block ends an open paragraph, or a sibling that needs no closing tag; only blocks are looked at.
            ends, limit = ENDS_ITSELF.get(tag, set()) | {"p"}, BOUNDARY.get(tag, set())
            at, k = 0, stack[-1][6]
            while k:
                t = stack[k][0]
                if t in ends and t not in limit:
                    at = k
                elif t not in ends:
                    break
                k = stack[k - 1][6]
            if at:
                leave(at)
        if tag in VOID or rest.endswith("/") and tag not in BLOCK_TAGS:
            continue
        _, path, above, hidden, label, holder, block = stack[-1]
        named: list[str] = []
        if "=" in rest:
            for key, a, b, c in NAMES.findall(rest):
                if key.lower() == "data-y":
                    label = int((a or b or c) == "1")
                else:
                    named += ["c:" + w.lower() for w in CUE.findall(a or b or c)]
        numbers += 1
        fresh = [*(["in:" + tag] if tag in BLOCK_TAGS and tag not in ("html", "body") else []), *named]
        if fresh:
            # Each feature once, the nearest last.
            path = (*(p for p in path if p not in fresh), *dict.fromkeys(fresh))
        if tag in BLOCK_TAGS:
            holder, block = above, len(stack)
        stack.append((tag, path, numbers, hidden or tag in HIDDEN, label, holder, block))
        is_open[tag] += 1
        if tag in RAW:
            # Raw text is never part of a block; a kind that is not closed once is not sought again.
            closing = re.compile("</" + tag + r"\s*>", re.I).search(page, pos) if raw_ends.get(tag, True) else None
            raw_ends[tag] = closing is not None
            pos = closing.end() if closing else n
            leave(len(stack) - 1)
    flush()
    return out


def features(blocks: list[Block]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """For each block: features of its ancestors, features of its text and place."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words, share = b.text.count(" ") + 1, b.linked / max(1, len(b.text))
        tag = next((p for p in reversed(b.path) if p.startswith("in:")), "in:")
        own = [
            "tag:" + tag[3:], "link:" + ("0" if share == 0 else "some" if share < 0.5 else "most"),
            "words:" + ("3" if words <= 3 else "9" if words <= 9 else "24" if words <= 24 else "long"),
            "end:" + ("stop" if b.text[-1] in ".!?:\"'”»)…" else "open"), "at:" + ("first" if i == 0 else "last" if i == n - 1 else "inside"),
        ]
        if b.text[0] in "©®":
            own.append("begins:sign")
        out.append((tuple(sorted(set(b.path))), tuple(own)))
    return out


def joint(blocks: list[Block]) -> list[int]:
    """For each block but the first: 1 if it has the parent of the one before."""
    return [int(a.parent == b.parent) for a, b in zip(blocks, blocks[1:])]


class Field:
    """Weights: of features for the label text against rest, of label pairs by joint, of the bias."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs.tolist()
        self.known: dict[tuple[str, ...], float] = {}

    def unary(self, found: tuple[str, ...]) -> float:
        s = self.known.get(found)
        if s is None:
            s = sum(self.weights.get(f, 0.0) for f in found)
            if len(self.known) < 100_000:
                self.known[found] = s
        return s

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        bias = self.weights.get("", 0.0)
        score, back = (0.0, 0.0), []
        for i, (path, own) in enumerate(features(blocks)):
            u = bias + self.unary(path) + self.unary(own)
            if i == 0:
                score = (0.0, u)
                continue
            t = self.pairs[int(blocks[i].parent == blocks[i - 1].parent)]
            zero, one = (score[0] + t[0][0], score[1] + t[1][0]), (score[0] + t[0][1], score[1] + t[1][1])
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            score = (max(zero), max(one) + u)
        y = int(score[1] > score[0])
        labels = [y]
        for b in reversed(back):
            y = b[y]
            labels.append(y)
        return labels[::-1]


def train(pages: list[list[Block]], rounds: int = 200, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty; all pages advance together, block by block."""
    pages = [p for p in pages if p and all(b.label >= 0 for b in p)]
    index: dict[str, int] = {"": 0}
    rows, cols, y, step, same = [], [], [], [], []
    starts = np.cumsum([0] + [len(p) for p in pages])
    for p, start in zip(pages, starts):
        for i, (path, own) in enumerate(features(p)):
            for f in ("", *path, *own):
                rows.append(start + i)
                cols.append(index.setdefault(f, len(index)))
        y += [b.label for b in p]
        same += [0, *joint(p)]
    if not pages:
        return Field({}, np.zeros((2, 2, 2)))
    rows, cols, y, same = np.array(rows), np.array(cols), np.array(y), np.array(same)
    size, total = len(index), len(y)
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    # Blocks by their place: at place t those of all pages longer than t, longest pages first.
    longest = int(lengths.max())
    at = [starts[order[: int((lengths > t).sum())]] + t for t in range(longest)]
    params = np.zeros(size + 8)
    m, v = np.zeros(size + 8), np.zeros(size + 8)
    for it in range(1, rounds + 1):
        u = np.bincount(rows, params[cols], total)
        pairs = params[size:].reshape(2, 2, 2)
        emit = np.stack([np.zeros(total), u], 1)
        alpha, beta = np.zeros((total, 2)), np.zeros((total, 2))
        alpha[at[0]] = emit[at[0]]
        for t in range(1, longest):
            now = at[t]
            alpha[now] = np.logaddexp.reduce(alpha[now - 1][:, :, None] + pairs[same[now]], axis=1) + emit[now]
        for t in range(longest - 1, 0, -1):
            now = at[t]
            beta[now - 1] = np.logaddexp.reduce(pairs[same[now]] + (emit[now] + beta[now])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha + beta, axis=1)
        p = np.exp(alpha + beta - z[:, None])[:, 1]
        grad = np.append(np.bincount(cols, (p - y)[rows], size), np.zeros(8))
        now = np.concatenate(at[1:]) if longest > 1 else np.empty(0, int)
        if len(now):
            both = np.exp(alpha[now - 1][:, :, None] + pairs[same[now]] + (emit[now] + beta[now])[:, None, :] - z[now][:, None, None])
            both[np.arange(len(now)), y[now - 1], y[now]] -= 1
            for s in (0, 1):
                grad[size + 4 * s : size + 4 * s + 4] = both[same[now] == s].sum(0).ravel()
        grad = grad / len(pages) + penalty * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-9)
    return Field({f: float(params[i]) for f, i in index.items()}, params[size:].reshape(2, 2, 2))


# Names that pages give to their parts.
TEXT_NAMES = ["content", "post-body", "entry-content", "article-text", "story", "main-content", "post", "articleBody", "body-copy", "text"]
REST_NAMES = {
    "nav": ["nav", "menu", "main-menu", "breadcrumb", "pagination", "toc"],
    "header": ["header", "masthead", "topbar", "site-header", "logo"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal"],
    "aside": ["sidebar", "widget", "related", "recommended", "side", "trending", "tags"],
    "div": ["ad", "ads", "advert", "banner", "sponsored", "promo", "cookie", "notice", "consent", "popup", "alert", "share", "social", "newsletter"],
    "form": ["form", "search", "login", "subscribe", "signup", "newsletter"],
    "section": ["comments", "comment", "comment-list", "replies", "reader-comments", "discussion"],
}
# Texts and other parts of the layouts shipped with the operator.
TEXTS = """The river rose slowly during the night, and by morning the lower fields stood under a sheet of brown water that reached the road.
Engineers tested the bridge for three weeks before it was opened, and found that it could carry twice the load it had been built for.
She learned the language from her grandmother, who had spoken nothing else until she was sent to school at the age of nine.
A short note on the method: every sample was weighed twice, dried for a day, and weighed again by another person.
"We never thought the old mill would be of use again," the owner said, "but the wheel still turns as it did a century ago."
Prices fell in the spring, rose again in early summer, and have stayed close to last year's level since then.
The report does not say who made the decision, although several of the people named in it were present when it was taken.
In the second half of the play the tone changes: what began as a comedy of errors becomes a quiet study of two lonely people.
To make the dough, mix the flour with the salt, add the water a little at a time, and let it rest for at least an hour.
Most birds leave the island in September, but a few hundred stay through the winter near the warm springs on the southern shore.
The court found that the contract had never been signed.
Nothing of the first building remains except a part of the northern wall, which was used again when the church was rebuilt.""".split("\n")
RESTS = """Home
About us
Contact
Privacy policy
Terms of use
© 2024 All rights reserved.
Sign in
Subscribe to our newsletter and get the latest stories every week.
This site uses cookies. Accept all
Share this page
Most read this week
Related stories
Advertisement
Search the archive
Follow us
Leave a comment""".split("\n")
MOST_BLOCKS = 400
OUTSIDE = {"in:nav", "in:footer", "in:aside", "in:form", "c:comments", "c:comment", "c:ad"}


def by_tags(blocks: list[Block]) -> list[Block]:
    """Labels from the page's own article or main element, or none if it has none."""
    inside = [bool({"in:article", "in:main"} & set(b.path)) and not OUTSIDE & set(b.path) for b in blocks]
    if not any(inside):
        return []
    for b, y in zip(blocks, inside):
        b.label = int(y)
    return blocks


def laid_out(text: list[str], rest: list[str], seed: int) -> str:
    """A page with the text in some container, and the rest around and inside it."""
    r = random.Random(seed)
    esc = lambda s: html.escape(s, quote=False)
    few = lambda: r.choice(rest) if rest else "Home"
    short = lambda: " ".join(few().split()[: r.randint(1, 4)])

    def part(tag: str) -> str:
        name = r.choice(REST_NAMES[tag])
        own = tag if r.random() < 0.5 else "div"
        if tag == "nav":
            inner = "<ul>" + "".join(f'<li><a href="#">{esc(short())}</a></li>' for _ in range(r.randint(2, 7))) + "</ul>"
        elif tag == "section":
            whole = r.random() < 0.5
            inner = "".join(
                f'<{"article" if whole else "div"} class="comment"><p>{esc(few())}</p><p>{esc(" ".join(r.choice(text).split()[:30]))}</p></{"article" if whole else "div"}>'
                for _ in range(r.randint(1, 4))
            )
        elif tag == "form":
            inner = f'<label>{esc(short())}</label><input name="q"><p>{esc(few())}</p>'
        elif tag == "aside":
            inner = f"<h3>{esc(short())}</h3><ul>" + "".join(f'<li><a href="#">{esc(few())}</a></li>' for _ in range(r.randint(1, 5))) + f"</ul><p>{esc(few())}</p>"
        else:
            inner = r.choice([esc(few()), f"<p>{esc(few())}</p>", f'<p>{esc(few())} <a href="#">{esc(short())}</a></p>'])
        said = f' class="{name}"' if r.random() < 0.7 or own == "div" else f' id="{name}"' if r.random() < 0.5 else ""
        return f'<{own}{said} data-y="0">{inner}</{own}>'

    tag = r.choice(["article", "main", "div", "div", "div", "section", "td"])
    named = tag in ("div", "section", "td") or r.random() < 0.5
    said = r.choice([' class="{}"', ' id="{}"']).format(r.choice(TEXT_NAMES)) if named else ""
    kind = lambda: r.choice(["p", "p", "p", "p", "p", "li", "blockquote", "h2", "pre", "div"])
    body = [f"<h1>{esc(' '.join(text[0].split()[:8]))}</h1>"]
    for t in text:
        k = kind()
        body.append({"li": f"<ul><li>{esc(t)}</li></ul>"}.get(k, f"<{k}>{esc(t)}</{k}>"))
        if r.random() < 0.12:
            body.append(part(r.choice(["div", "aside", "form"])))
    if r.random() < 0.4:
        body.append(part("section"))
    main = f'<{tag}{said} data-y="1">{"".join(body)}</{tag}>'
    main = f"<table><tr>{main}<td data-y='0'>{part('aside')}</td></tr></table>" if tag == "td" else main
    before = [part(t) for t in ("header", "nav", "div", "form") if r.random() < 0.6]
    after = [part(t) for t in ("section", "aside", "form", "div", "footer") if r.random() < 0.6]
    r.shuffle(before)
    return f'<html><head><title>x</title></head><body data-y="0">{"".join(before)}{main}{"".join(after)}</body></html>'


def labelled(pages: list[list[Block]], anew: int = 3) -> list[list[Block]]:
    """Training pages: each sampled page that names its text, and ``anew`` new layouts of it."""
    out = []
    for i, blocks in enumerate(pages):
        out.append(blocks)
        text, rest = ([b.text for b in blocks if b.label == y] for y in (1, 0))
        # Long blocks are shortened here for speed; only their length class counts.
        text = [" ".join(t.split()[:60]) for t in text[:30]]
        out += [leaf_blocks(laid_out(text, rest, i * anew + k)) for k in range(anew)]
    return out


def window(blocks: list[Block]) -> list[Block]:
    """The blocks of a page that training looks at: ``MOST_BLOCKS`` in a row, from a little before its text."""
    first = next((i for i, b in enumerate(blocks) if b.label == 1), 0)
    start = max(0, min(first - MOST_BLOCKS // 4, len(blocks) - MOST_BLOCKS))
    return blocks[start : start + MOST_BLOCKS]


def named_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, blocks) of the pages that say what their text is: a JSON list of blocks, their texts cut to 60 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for name, page in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
                blocks = window(by_tags(leaf_blocks(page)))
                if blocks:
                    ids.append(name)
                    # The last word stays the last, as its mark counts; the share of linked text is kept.
                    rows = []
                    for b in blocks:
                        ws = b.text.split()
                        text = b.text if len(ws) <= 60 else " ".join(ws[:59] + ws[-1:])
                        rows.append((text, b.path, b.parent, b.linked * len(text) / max(1, len(b.text)), b.label))
                    found.append(json.dumps(rows))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["page_id", "blocks"])

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return named.mapInArrow(run, "page_id long, blocks string")


def shipped(pages: int = 30) -> list[list[Block]]:
    """Labelled layouts of fixed texts, for tables in which no page says what its text is."""
    r = random.Random(1)
    return [leaf_blocks(laid_out(r.sample(TEXTS, r.randint(3, 8)), r.sample(RESTS, 8), i)) for i in range(pages * 4)]


def fit(pages: DataFrame, sample: int = 200) -> Field:
    """Trains on at most ``sample`` pages whose article or main element says what their text is, those with the smallest
    hash of their number; pages of any length, of which ``MOST_BLOCKS`` blocks count. Without such a page, on ``shipped``."""
    named = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    take = sample
    while True:
        ids = named.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(take)
        ids = materialize(ids, "sampled")
        # Null is a number like any other here.
        chosen = named.join(F.broadcast(ids.distinct().withColumnRenamed("page_id", "__id")), F.col("page_id").eqNullSafe(F.col("__id")), "left_semi")
        rows = named_blocks(chosen).limit(sample).collect()
        # Some only look as if they said it: then more are asked, until the table ends.
        if len(rows) >= sample or ids.count() < take:
            break
        take *= 4
    rows.sort(key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["blocks"]))
    found = [[Block(t, tuple(path), parent, linked, y) for t, path, parent, linked, y in json.loads(r["blocks"])] for r in rows]
    return train(labelled(found) or shipped())


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks - one row per page."""
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, np.array(field.pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            for piece in slices(batch, "html"):
                texts, counts = [], []
                for page in piece["html"].to_pylist():
                    blocks = leaf_blocks(page)
                    kept = [b.text for b, y in zip(blocks, own.decode(blocks)) if y]
                    texts.append("\n".join(kept))
                    counts.append(len(kept))
                yield pa.RecordBatch.from_arrays(
                    [piece["page_id"], piece["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return named.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def main_text(pages: DataFrame, sample: int = 200) -> DataFrame:
    return extract(pages, fit(pages, sample))
