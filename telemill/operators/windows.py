"""The rules with their declared time windows: tumbling (batch and stream) and sliding (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators.detection import Inputs, Rules
from telemill.operators.ordered import Order, previous_ts, running_totals

WINDOW_COLUMNS = ["client_id", "rule_name", "severity", "action", "blocked", "window_start", "observed"]


def _alerts(counted: DataFrame, rules: Rules, keys: dict[str, str]) -> DataFrame:
    """Alert rows from one table of counts per client and window; ``keys`` maps rule to count column."""
    found = [
        F.when(F.col(column) > rules[key].threshold, F.struct(
            F.lit(rules[key].name).alias("rule_name"), F.lit(rules[key].severity).alias("severity"),
            F.lit(rules[key].action).alias("action"), F.lit(rules[key].blocked).alias("blocked"),
            F.col(column).alias("observed")))
        for key, column in keys.items()
    ]
    return (counted.withColumn("_alert", F.explode(F.array_compact(F.array(*found))))
            .select("client_id", "_alert.rule_name", "_alert.severity", "_alert.action", "_alert.blocked",
                    F.col("_window.start").alias("window_start"), "_alert.observed")
            .select(*WINDOW_COLUMNS))


def _windowed(df: DataFrame, seconds: int, *more: str):
    return df.groupBy("client_id", F.window("ts", f"{seconds} seconds").alias("_window"), *more)


def windowed_counts(features: DataFrame, seconds: int, distinct_topics: bool = True) -> DataFrame:
    """Messages, topics, QoS 2 and retained messages per client and tumbling window.

    Topics are counted by a second aggregation over one row per client, window and topic. Both steps combine
    before the shuffle and keep plain counts, in batch as on a stream, so no set of topics is ever held.
    """
    inputs = Inputs.of(features)
    measures = {
        "messages": F.count("*"), "qos2": F.count_if(inputs.is_qos2), "retained": F.count_if(inputs.retained)}
    if not distinct_topics:
        return _windowed(features, seconds).agg(*[m.alias(n) for n, m in measures.items()])
    per_topic = _windowed(features, seconds, "topic").agg(*[m.alias(n) for n, m in measures.items()])
    return per_topic.groupBy("client_id", "_window").agg(
        *[F.sum(n).alias(n) for n in measures], F.count("*").alias("topics"))


def _by_window(rules: Rules, columns: dict[str, str]) -> dict[int, dict[str, str]]:
    grouped: dict[int, dict[str, str]] = {}
    for key, column in columns.items():
        grouped.setdefault(rules[key].window_seconds, {})[key] = column
    return grouped


def detect_windowed(features: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Clients over a rule's threshold within one tumbling window; rules of equal width share one pass."""
    rules = rules or Rules()
    columns = {"flood_detection": "messages", "topic_enumeration": "topics", "qos_abuse": "qos2",
               "retain_abuse": "retained"}
    parts = [
        _alerts(windowed_counts(features, seconds, "topics" in keys.values()), rules, keys)
        for seconds, keys in _by_window(rules, columns).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sliding_counts(features: DataFrame, widths: dict[int, tuple[str, ...]], **order_options) -> DataFrame:
    """Add, per width in seconds, measures of the client in the window that ends at each row, as ``<measure>_<seconds>``.

    Every row adds at its own time and takes back when it leaves a window, so the counts are running sums; one sweep over
    the rows and their departures serves all widths. A topic counts once: a row that follows another of its topic within the
    window takes the overlap back.
    """
    features = features.where(F.col("ts").isNotNull())
    inputs = Inputs.of(features)
    order = Order(("client_id",), **order_options)
    adds = {"messages": F.lit(1), "topics": F.lit(1), "qos2": inputs.is_qos2.cast("int"), "retained": inputs.retained.cast("int")}
    columns = {f"{measure}_{seconds}": (measure, seconds) for seconds, measures in widths.items() for measure in measures}
    used = {measure for measure, _ in columns.values()}
    flat = features.select("client_id", "topic", "ts", "seq", *[adds[n].alias(n) for n in sorted(used - {"topics"})])
    if "topics" in used:
        flat = previous_ts(flat, Order(("client_id", "topic"), **order_options), "_before")
    before_instant = F.lit(None).cast(dict(flat.dtypes)["seq"])

    def entry(at: Column, seq: Column, changed: dict[str, Column]) -> Column:
        return F.struct(at.alias("ts"), seq.alias("seq"),
                        *[changed.get(name, F.lit(0)).cast("int").alias(name) for name in columns])

    changes = []
    for seconds, measures in widths.items():
        micros = seconds * 1_000_000
        value = {f"{m}_{seconds}": -(F.lit(1) if m == "topics" else F.col(m)) for m in measures}
        changes.append(entry(F.timestamp_micros(F.unix_micros("ts") + micros + 1), before_instant, value))
        if "topics" in measures:
            repeated = F.unix_micros("ts") - F.unix_micros("_before") <= micros
            overlap_ends = F.timestamp_micros(F.unix_micros("_before") + micros + 1)
            changes += [F.when(repeated, entry(F.col("ts"), F.col("seq"), {f"topics_{seconds}": F.lit(-1)})),
                        F.when(repeated, entry(overlap_ends, before_instant, {f"topics_{seconds}": F.lit(1)}))]
    markers = flat.select("client_id", F.inline(F.array_compact(F.array(*changes))))
    return running_totals(features, order, {name: adds[measure] for name, (measure, _) in columns.items()}, markers)


def detect_sliding(features: DataFrame, rules: Rules | None = None, **order_options) -> DataFrame:
    """Rows at which a client is over a rule's threshold within the window that ends there."""
    rules = rules or Rules()
    measured = {"flood_detection": "messages", "topic_enumeration": "topics", "qos_abuse": "qos2", "retain_abuse": "retained"}
    widths = {seconds: tuple(keys.values()) for seconds, keys in _by_window(rules, measured).items()}
    counted = sliding_counts(features, widths, **order_options).withColumn("_window", F.struct(F.col("ts").alias("start")))
    columns = {key: f"{measure}_{rules[key].window_seconds}" for key, measure in measured.items()}
    return _alerts(counted, rules, columns).withColumnRenamed("window_start", "ts")


def reconnect_storm(canonical: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Clients with too many CONNECT packets in one window; needs canonical rows with ``ts``."""
    rules = rules or Rules()
    rule = rules["reconnect_storm"]
    connects = canonical.where(F.col("packet_type") == "CONNECT")
    counted = _windowed(connects, rule.window_seconds).agg(F.count("*").alias("reconnects"))
    return _alerts(counted, rules, {"reconnect_storm": "reconnects"})


def duplicate_client(canonical: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Clients seen from more than one source address in one window; needs canonical rows with ``ts``."""
    rules = rules or Rules()
    rule = rules["duplicate_client"]
    known = canonical.where(F.coalesce(F.col("src_ip"), F.lit("")) != "")
    per_address = _windowed(known, rule.window_seconds, "src_ip").agg(F.count("*").alias("messages"))
    counted = per_address.groupBy("client_id", "_window").agg(F.count("*").alias("addresses"))
    return _alerts(counted, rules, {"duplicate_client": "addresses"})
