"""Detection as a stream.

Row rules need no state. Window rules keep counts per client and window until the watermark passes it; distinct
topics and addresses are counted over a first aggregation per topic or address, so no set is kept as one value.
Cumulative rules keep counts per client for as long as the query, restarts included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from telemill.operators.detection import CHECK_ORDER, COUNTED, Inputs, Rules, detect_stateless, findings, raise_alerts
from telemill.operators.windows import detect_windowed, duplicate_client, reconnect_storm
from telemill.streaming.running import with_running_counts


def row_alerts(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Wildcard, payload size and system topic alerts, emitted at once."""
    return detect_stateless(rows, rules)


def window_alerts(rows: DataFrame, rules: Rules | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Flood, enumeration, QoS and retain alerts per closed window; later rows are dropped and counted by Spark."""
    return detect_windowed(rows.withWatermark("ts", watermark), rules)


def connection_alerts(canonical: DataFrame, rules: Rules | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Reconnect storms and clients seen from several addresses, per closed window."""
    rows = canonical.withWatermark("ts", watermark)
    return reconnect_storm(rows, rules).unionByName(duplicate_client(rows, rules))


def cumulative_alerts(rows: DataFrame, rules: Rules | None = None, checks: list[str] | None = None, idle: str | None = None,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """Alerts of the rules that count over the whole run (flood, enumeration, QoS, retain), one per row past a threshold.

    The same rows as ``detect`` gives, if rows arrive in order (see ``running``). ``rows`` needs ts, client_id and a unique
    seq; ``checks`` may also name the row rules, which need no state.
    """
    rules, checks = rules or Rules(), checks or [key for key in CHECK_ORDER if key in COUNTED]
    read = ("ts", "seq", "client_id", "topic", "payload_length", "qos", "retain", "retain_flag", *keep)
    needed = [name for name in dict.fromkeys(read) if name in rows.columns]
    inputs = Inputs.among(needed)
    narrow = rows.select(*needed)
    if "topic" not in needed:
        narrow = narrow.withColumn("topic", inputs.topic)
    # rows without a topic are never checked for retention, so they do not count towards it
    counted = with_running_counts(narrow, inputs.is_qos2, inputs.retained & inputs.topic.isNotNull(), idle=idle)
    found = findings(rules, inputs, {name: counted[name] for name in COUNTED.values()})
    return raise_alerts(counted, rules, {key: text for key, text in found.items() if key in checks}, inputs.topic, keep)
