"""The query catalogue: every operator over the given tables, with plain SQL beside it."""

from __future__ import annotations

from glossweave.plans.catalog import base
from glossweave.plans.catalog import graphs, languages, sources, streams, tables, text, vectors, words, writes  # noqa: F401

QUERIES = base.QUERIES
SQL = base.SQL
