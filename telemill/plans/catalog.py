"""All registered queries."""

from __future__ import annotations

from telemill.plans import detection_queries, feature_queries, field_queries  # noqa: F401
from telemill.plans.registry import ORACLES, PLANS, callables

__all__ = ["ORACLES", "PLANS", "callables"]
