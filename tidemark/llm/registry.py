"""The queries of this subpackage and the SQL that each is held against."""

from __future__ import annotations

from . import decontaminate, exact_dedup, lm_score, main_text, merkle_manifest, ngram_join, packing, pii, quality, sentence_pieces, source_audit, token_counts, toxicity

MODULES = (exact_dedup, ngram_join, decontaminate, packing, token_counts, lm_score, quality, toxicity, main_text, pii, merkle_manifest, sentence_pieces, source_audit)


def queries() -> dict:
    return {name: call for module in MODULES for name, call in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
