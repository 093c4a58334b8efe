"""All registered queries and oracles."""

from __future__ import annotations

from checks import analysis_queries, ingest_queries, result_queries

MODULES = (analysis_queries, ingest_queries, result_queries)


def all_queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
