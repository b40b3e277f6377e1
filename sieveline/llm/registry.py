"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import cases, decontamination, html_text, near_dedup, packing, quality_rules, quotation, sharding, substring_dedup, token_counts, toxicity

MODULES = (cases, decontamination, html_text, near_dedup, packing, quality_rules, quotation, sharding, substring_dedup, token_counts, toxicity)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
