"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from quillmark.plans import assets, corpus, flows, pairs, rankings, review, texts

MODULES = [corpus, rankings, assets, pairs, review, texts, flows]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
