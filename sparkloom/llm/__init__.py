"""Operators for preparing training data at scale, and the queries that apply them."""

from __future__ import annotations

from sparkloom.llm import bpe, chat_format, exact_dedup, language_id, mixing, phrase_mining, pii, sentencepieces, simhash, source_divergence, substring_dedup, topk_search, toxicity

MODULES = [mixing, substring_dedup, toxicity, simhash, chat_format, exact_dedup, pii, bpe, language_id, topk_search, source_divergence, sentencepieces, phrase_mining]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
