"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from wordmine.llm import cooccur, leakage, lookalike, packing, personal, reading, sentences, term_counts

MODULES = [personal, lookalike, term_counts, sentences, cooccur, packing, leakage, reading]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
