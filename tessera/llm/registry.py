"""Queries of the text operators, by name, and the SQL that checks them."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = ("toxicity", "mixing", "decontamination", "quality_model", "warc", "language", "suffix", "token_store", "jaccard", "quality_rules", "html_text", "merkle", "filter_audit")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"tessera.llm.{name}").QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tessera.llm.{name}"), "ORACLES", {})
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
