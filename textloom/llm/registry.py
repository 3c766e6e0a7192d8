"""Queries and reference SQL of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ("toxicity", "language_model", "urls", "html_text", "packing", "decontaminate", "chat", "simhash", "pii", "quality")


def _parts():
    return [importlib.import_module(f"textloom.llm.{m}") for m in MODULES]


def queries() -> dict:
    found = {}
    for part in _parts():
        found.update(part.QUERIES)
    found["pipeline"] = importlib.import_module("corpus_pipeline").run
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for part in _parts():
        found.update(part.ORACLE_SQL)
    return found
