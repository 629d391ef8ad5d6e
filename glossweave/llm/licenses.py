"""Licence notices and texts in files, by a positional index of rare licence words.

A template is a passage of a licence with a label, a share of its words that
must stand in place, and key phrases that must stand in place whole. The
documents say how rare each licence word is (its document frequency over the
whole table). A template of n words of which m must be in place is filed under
its n - m + 1 places of highest IDF: any text that holds the template holds one
of them, so nothing is missed. A file's words that are filed, its licence words
of highest IDF, are looked up; each posting (template, place) names a relative
position, a start of the template in the file. Postings of all words of the
template are intersected at that start by counting words in place, and the key
phrases are verified there. A place inside a longer one of another template
belongs to that one and has no label of its own.

The three base phrases are templates with all words mandatory. ``score`` is
the greatest share of a template's words in place (0 without any).

Defined cases: a null text is an empty one, with no words. Repeated rows and
rows with a null id are rows of their own. Very long texts are looked up whole;
starts are verified in blocks, so memory goes with the text. No table, no
frequencies: every word counts as equally rare, and there is nothing to report.
Only ``doc_id`` and ``text`` are read, other columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossweave.llm.common import slices

#: Everything but 0-9, letters (A-Z folded) and bytes of non-ASCII characters parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARE = 0.8
#: Starts of one template that are verified at once.
BLOCK = 4096


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


@dataclass
class Template:
    """A licence passage; ``base`` names the phrase that is counted, for the base phrases."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    share: float = SHARE
    base: bool = False
    words: list[bytes] = field(init=False)
    least: int = field(init=False)
    fixed: list[int] = field(init=False)

    def __post_init__(self):
        self.words = words(self.text)
        n = len(self.words)
        if not n:
            raise ValueError(f"the template of {self.label} has no words")
        self.least = max(1, math.ceil(n * self.share - 1e-9))
        at = set(range(n)) if self.least == n else set()
        for key in map(words, self.keys):
            starts = [i for i in range(n - len(key) + 1) if self.words[i : i + len(key)] == key]
            if not key or not starts:
                raise ValueError(f"a key phrase of {self.label} is not in its template")
            at.update(range(starts[0], starts[0] + len(key)))
        self.fixed = sorted(at)


# The base phrases and their labels.
BASE = [
    Template("mit", "mit license", share=1.0, base=True),
    Template("apache", "apache license", share=1.0, base=True),
    Template("gpl", "general public license", share=1.0, base=True),
]

# Passages of public licences without their variable parts, and the phrases that tell them apart.
PASSAGES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
             " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
             " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
             " persons to whom the Software is furnished to do so, subject to the following conditions",
             ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
             " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
             ("apache license version 2 0",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
             " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
             " version", ("gnu general public license", "free software foundation")),
    Template("gpl", "licensed under the GNU General Public License", ("gnu general public license",)),
    Template("lgpl", "GNU Lesser General Public License", ("lesser general public license",), 1.0),
    Template("agpl", "GNU Affero General Public License", ("affero general public license",), 1.0),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
             " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
             " conditions and the following disclaimer",
             ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written"
             " permission", ("endorse or promote products",)),
    Template("bsd", "BSD License", (), 1.0),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
             " granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("with or without fee is hereby granted",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
             " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", ("mozilla public license",)),
    Template("mpl", "Mozilla Public License", (), 1.0),
    Template("epl", "Eclipse Public License", (), 1.0),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
             " liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
    Template("boost", "Boost Software License", (), 1.0),
    Template("cc0", "CC0 1.0", (), 1.0),
    Template("cc-by", "licensed under CC BY", (), 1.0),
    Template("cc-by-sa", "licensed under CC BY-SA", (), 1.0),
    Template("cc-by-nc", "licensed under CC BY-NC", (), 1.0),
    Template("cc-by-nd", "licensed under CC BY-ND", (), 1.0),
    Template("cc-by-nc-sa", "licensed under CC BY-NC-SA", (), 1.0),
    Template("cc-by-nc-nd", "licensed under CC BY-NC-ND", (), 1.0),
    Template("cc-by", "Creative Commons Attribution", (), 1.0),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike", (), 1.0),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial", (), 1.0),
    Template("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike", (), 1.0),
]
TEMPLATES = BASE + PASSAGES


def frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and the number of documents; one row per licence word reaches the driver."""
    vocabulary = {w for t in templates for w in t.words}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for whole in batches:
            for part in slices(whole, "text"):
                for text in part["text"].to_pylist():
                    n += 1
                    found.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": [b"", *found], "n": [n, *found.values()]}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    summed = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").sum("n").collect()
    counts = {bytes(w): n for w, n in summed}
    return counts, counts.pop(b"", 0)


class Index:
    """Rare places of all templates, filed under their words."""

    def __init__(self, counts: dict[bytes, int], documents: int, templates: list[Template] = TEMPLATES):
        self.templates = templates
        self.numbers = {w: i for i, w in enumerate(sorted({w for t in templates for w in t.words}))}
        self.rows = [np.array([self.numbers[w] for w in t.words], np.int32) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            idf = [math.log((documents + 1) / (counts.get(w, 0) + 1)) for w in t.words]
            rarest = sorted(range(len(idf)), key=lambda i: (-idf[i], i))[: len(idf) - t.least + 1]
            for i in rarest:
                self.postings.setdefault(t.words[i], []).append((k, i))
        self.rare = frozenset(self.postings)

    def found(self, ws: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, words in place) of every place that has enough words and all key phrases."""
        here = self.rare.intersection(ws)
        if not here:
            return []
        ids = np.fromiter((self.numbers.get(w, -1) for w in ws), np.int32, len(ws))
        starts: dict[int, list[np.ndarray]] = {}
        for w in here:
            at = np.flatnonzero(ids == self.numbers[w])
            for k, i in self.postings[w]:
                starts.setdefault(k, []).append(at - i)
        out = []
        for k, parts in starts.items():
            t, row = self.templates[k], self.rows[k]
            n = len(row)
            at = np.unique(np.concatenate(parts))
            # A template may hang over either end of the file with words that are then not in place.
            padded = np.concatenate([np.full(n, -1, np.int32), ids, np.full(n, -1, np.int32)])
            for b in range(0, len(at), BLOCK):
                some = at[b : b + BLOCK]
                equal = padded[some[:, None] + np.arange(n, 2 * n)] == row
                good = (equal.sum(axis=1) >= t.least) & equal[:, t.fixed].all(axis=1)
                out += [(k, int(s), int(e)) for s, e in zip(some[good], equal[good].sum(axis=1))]
        return out

    def labelled(self, found: list[tuple[int, int, int]]) -> set[str]:
        """Labels of base phrases, and of places that are not inside a longer place of another label."""
        spans = [(s, s + len(self.rows[k]), self.templates[k].label) for k, s, _ in found]
        labels = {self.templates[k].label for k, _, _ in found if self.templates[k].base}
        reach: list[tuple[int, int, str]] = []
        for s, e, label in sorted(spans, key=lambda x: (x[0], -x[1])):
            # Only places that end behind s can hold it; templates are short, so few do.
            reach = [r for r in reach if r[1] > s]
            if not any(b - a > e - s and b >= e and other != label for a, b, other in reach):
                labels.add(label)
            reach.append((s, e, label))
        return labels


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_places long"
)


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places), one row per row.

    ``n_base``, ``first_word`` and ``last_word`` are of the base phrases,
    ``n_places`` counts the places of all templates.
    """
    counts, documents = frequencies(docs, templates)
    index = Index(counts, documents, templates)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                columns = {name: [] for name in names}
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ws = words(text)
                    found = index.found(ws)
                    base = sorted(s for k, s, _ in found if templates[k].base)
                    row = (
                        doc, len(ws), len(base), base[0] if base else None, base[-1] if base else None,
                        ",".join(sorted({templates[k].label for k, _, _ in found if templates[k].base})),
                        ",".join(sorted(index.labelled(found))),
                        max((e / len(templates[k].words) for k, _, e in found), default=0.0), len(found),
                    )
                    for name, value in zip(names, row):
                        columns[name].append(value)
                yield pa.RecordBatch.from_pydict(columns, schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
    return docs.select("doc_id", "text").mapInArrow(look, SCHEMA)


def template_values(templates: list[Template] = TEMPLATES) -> str:
    """Rows (k, label, base, n, least, place, word, fixed) of the templates, as a SQL list of values."""
    rows = []
    for k, t in enumerate(templates):
        fixed = set(t.fixed)
        rows += [
            f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {t.least}, {i}, '{w.decode()}', {str(i in fixed).lower()})"
            for i, w in enumerate(t.words)
        ]
    return ",\n".join(rows)
