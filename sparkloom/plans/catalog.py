"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators import activation, branching, citation, communities, context, corpus, dialogue, epochs, extraction, fragments, graph, journal, knowledge, mapping, messages, observations, projection, publication, recall, reports, responses, search, sentences, snapshots, strategies, upkeep, vectors
from sparkloom.sources import documents
from sparkloom.streaming import consumer, dispatch

Query = Callable[[SparkSession, str], DataFrame]

MODULES: list = [corpus, sentences, messages, knowledge, graph, projection, communities, vectors, journal, context, citation, activation, observations, reports, fragments, search, branching, mapping, publication, recall, epochs, extraction, dialogue, responses, snapshots, strategies, upkeep, documents, consumer, dispatch]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact vector search joined back to its text units, in corpus order under a token budget."""
    return search.basic_search(spark, sf_dir)
