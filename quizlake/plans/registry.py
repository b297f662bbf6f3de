"""Named queries: a Spark plan over the test tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Enter a plan under ``name``."""

    def enter(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(plan, sql)
        return plan

    return enter
