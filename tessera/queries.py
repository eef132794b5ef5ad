"""Registry of the library's queries and of the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("operators.history", "operators.ingest", "operators.schedules", "operators.similarity", "operators.masks", "operators.losses", "operators.kernels", "operators.pixels", "plans.views", "plans.render", "sources.sinks", "streaming.metrics")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tessera.{name}"), attribute)
    return found


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["knn_predict"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
