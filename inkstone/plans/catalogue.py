"""All queries of the library outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, files, grounding, retrieval, service

MODULES = (documents, retrieval, grounding, files, service)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for module in MODULES for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
