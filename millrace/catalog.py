"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cohorts, criteria, documents, extractions, lists, narratives, packed, profiles, ranking, reviews, skills, texts

MODULES = (cohorts, criteria, documents, extractions, lists, narratives, packed, profiles, ranking, reviews, skills, texts)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
