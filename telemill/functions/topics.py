"""Topic names and topic filters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def filter_regex(topic_filter: str) -> str:
    """Regular expression for one topic filter over whole topics, line breaks included."""
    levels = topic_filter.split("/")
    start = r"(?s)\A(?!\$)" if levels[0] in ("+", "#") else r"(?s)\A"
    if levels[-1] == "#":
        head = [_level_regex(level) for level in levels[:-1]]
        return start + ("/".join(head) + r"(/.*)?\z" if head else r".*\z")
    return start + "/".join(_level_regex(level) for level in levels) + r"\z"


def _level_regex(level: str) -> str:
    return "[^/]*" if level == "+" else re.escape(level)


def topic_matches(topic: Column, topic_filter: str) -> Column:
    """True where ``topic`` falls under the filter (``+`` one level, ``#`` the rest)."""
    return F.coalesce(topic.rlike(filter_regex(topic_filter)), F.lit(False))


def device_from_topic(topic: Column) -> Column:
    """Device name of a topic with three or more levels, else ``unknown``."""
    levels = F.split(topic, "/")
    inner, outer = F.try_element_at(levels, F.lit(-2)), F.try_element_at(levels, F.lit(-3))
    return F.when(F.size(levels) >= 3, F.when(inner.contains("device"), outer).otherwise(inner)).otherwise(
        F.lit("unknown"))


def subscription_filters(
    topics: list[str] | None = None,
    all_zones: bool = False,
    zone: int | None = None,
    device_type: str | None = None,
) -> list[str]:
    """Preset filter sets; explicit topics win, then all zones, one zone, one device type."""
    if topics:
        return list(topics)
    if all_zones:
        return ["site/tenantA/+/+/+/telemetry", "site/+/+/+/+/+/telemetry"]
    if zone:
        return [f"site/tenantA/zone{zone}/+/+/telemetry"]
    if device_type:
        return [f"site/tenantA/+/{device_type}/+/telemetry"]
    # --- fixed values: default subscriptions ---
    return [
        "site/tenantA/zone1/temperature/+/telemetry",
        "site/tenantA/zone1/humidity/+/telemetry",
        "site/tenantA/zone2/co2/+/telemetry",
        "site/tenantA/zone3/vibration/+/telemetry",
        "site/tenantA/zone1/smoke/+/telemetry",
        "site/tenantA/zone4/airquality/+/telemetry",
        "site/tenantA/zone2/light/+/telemetry",
        "site/tenantA/zone2/sound/+/telemetry",
        "site/tenantA/zone5/waterlevel/+/telemetry",
    ]


def repair_topic(topic: Column, device_type: Column, record_index: Column) -> Column:
    """Replace a topic without levels by a well-formed one made from the device type."""
    number = F.lpad((record_index % 5 + 1).cast("int").cast("string"), 3, "0")
    made = F.concat(F.lit("site/canonical/"), F.lower(device_type), F.lit("/device_"), number,
                    F.lit("/telemetry"))
    return F.when(F.contains(topic, F.lit("/")), topic).otherwise(made)
