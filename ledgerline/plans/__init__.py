"""The registered queries: ``queries()`` and the SQL each is compared with."""

from __future__ import annotations

import importlib

MODULES = ["search_queries", "corpus_queries", "graph_queries", "analysis_queries", "report_queries", "vocabulary_queries", "extract_queries", "assembly_queries", "catalog_queries", "table_queries", "document_queries", "row_queries"]


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"ledgerline.plans.{m}"), name))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
