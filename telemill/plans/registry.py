"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telemill.plans.traffic import Tables, oracle

Plan = Callable[[Tables], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` is its check over the named views, if SQL can express it."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return plan

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plan(Tables(spark, folder))

    return {name: bind(plan) for name, plan in PLANS.items()}
