"""Dictionary entries out of web pages, by selectors, one page per row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements without content, and those a new one of the kind closes.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BLOCKS = set("address article aside blockquote div dl footer h1 h2 h3 h4 h5 h6 header nav ol section table ul".split())


@dataclass(frozen=True)
class Selectors:
    """Where a page keeps its entries: tag, .class, #id, and descendants of these."""

    entry: str
    headword: str
    language: str
    definition: str | None = None
    etymology: str | None = None
    ipa: str | None = None


class _Element:
    def __init__(self, tag: str, attrs: dict, parent: _Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[_Element]:
        for child in self.children:
            if isinstance(child, _Element):
                yield child
                yield from child.walk()

    def pieces(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child.strip()
            elif child.tag not in ("script", "style"):
                yield from child.pieces()


class _Page(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        closes = _SELF_CLOSING.get(tag, {"p"} if tag in _BLOCKS else set())
        if closes:
            self._close(closes, stop={"ul", "ol", "dl", "table", "div", "article", "section", "body"} - {tag})
        node = _Element(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        self._close({tag}, stop=set())

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent


def _matches(node: _Element, part: str) -> bool:
    for kind, name in re.findall(r"([.#]?)([\w-]+)", part):
        if kind == "." and name not in (node.attrs.get("class") or "").split():
            return False
        if kind == "#" and node.attrs.get("id") != name:
            return False
        if not kind and node.tag != name:
            return False
    return True


def _select(root: _Element, selector: str) -> Iterator[_Element]:
    *above, last = selector.split()
    for node in root.walk():
        if not _matches(node, last):
            continue
        wanted, up = list(above), node.parent
        while wanted and up is not None:
            if _matches(up, wanted[-1]):
                wanted.pop()
            up = up.parent
        if not wanted:
            yield node


def _text_of(entry: _Element, selector: str | None) -> str | None:
    if selector is None:
        return None
    node = next(_select(entry, selector), None)
    return "" if node is None else "".join(node.pieces()).replace("\n", " ").strip()


def extract_entries(pages: DataFrame, selectors: Selectors, url: str = "url", html: str = "html") -> DataFrame:
    """Entries of every page: headword, language and the fields that have a selector.

    Containers without a headword are left out. A page is parsed once, whole.
    """
    fields = {"headword": selectors.headword, "definition": selectors.definition,
              "etymology": selectors.etymology, "ipa": selectors.ipa}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, text in zip(pdf[url], pdf[html]):
                for entry in _select(_Page(text or "").root, selectors.entry):
                    values = {f: _text_of(entry, s) for f, s in fields.items()}
                    if values["headword"]:
                        rows.append({**values, "source_url": source})
            out = pd.DataFrame(rows, columns=[*fields, "source_url"])
            out["language"], out["source_type"] = selectors.language, "scraped_html"
            yield out

    kinds = ", ".join(f"{c} string" for c in (*fields, "source_url", "language", "source_type"))
    return pages.select(url, html).mapInPandas(run, kinds)
