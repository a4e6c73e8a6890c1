"""Registered queries: one module for each family, with each query's SQL beside it."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in getattr(m, "SQL", {}).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["lexical_pairs"](spark, sf_dir)
