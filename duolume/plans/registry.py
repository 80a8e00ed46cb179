"""All registered queries of the library, apart from the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("name_queries", "run_queries", "stat_queries", "box_queries", "pixel_queries", "score_queries", "source_queries", "table_queries", "field_queries", "store_queries")


def plans() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found |= import_module(f"duolume.plans.{name}").PLANS
    return found
