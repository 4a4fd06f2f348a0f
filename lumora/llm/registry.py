"""The queries of this subpackage and their DuckDB equivalents, by name."""

from __future__ import annotations

from lumora.llm import bpe, decontamination, lm_scoring, ngram_join, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_files

_MODULES = (quality_rules, quality_classifier, decontamination, sharding, bpe, suffix_dedup, substring_dedup, ngram_join, token_files, lm_scoring)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
