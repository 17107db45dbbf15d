"""All registered queries: name, plan and, where SQL can say it, the SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package, each with QUERIES and ORACLE.
MODULES = ["ledger", "pages", "entities", "graphs", "extras", "streams", "files", "chains", "indexes", "scale"]


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"vellum.plans.{name}"), what)
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
