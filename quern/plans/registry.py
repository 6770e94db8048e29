"""Name -> query and name -> oracle SQL for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that hold queries: each has QUERIES {name: callable} and ORACLES {name: sql}.
MODULES = ("retrieval", "navigation", "changes", "events", "evaluation", "texts", "facade", "filtering", "sinks", "machines", "scoring", "linking", "markdown", "properties")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for module in MODULES:
        found = getattr(import_module(f"quern.plans.{module}"), attribute)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
