"""Queries for detection, attack logs, cameras and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators import camera, detection, logs, report, windows
from telemill.operators.detection import Rules
from telemill.operators.features import message_fields
from telemill.plans.feature_queries import COLLECTED
from telemill.plans.registry import query
from telemill.plans.traffic import Tables, as_messages
from telemill.schemas import ATTACK_LOG_SCHEMAS
from telemill.session import scratch_path
from telemill.sources import messages as message_source
from telemill.sources import tables
from telemill.streaming import collect, detect, handshakes, sinks

# --- detection over the whole run ---

RUNNING = """numbered AS (
    SELECT seq, ts, client_id, topic, length(payload) AS size, qos, retain AS retained,
      CASE WHEN row_number() OVER (PARTITION BY client_id, topic ORDER BY ts NULLS LAST, seq) = 1 THEN 1 ELSE 0 END AS fresh
    FROM traffic),
  running AS (
    SELECT *, count(*) OVER so_far AS messages, sum(fresh) OVER so_far AS topics,
      count(*) FILTER (qos = 2) OVER so_far AS qos2,
      count(*) FILTER (retained = 1 AND topic IS NOT NULL) OVER so_far AS retained_count
    FROM numbered WINDOW so_far AS (PARTITION BY client_id ORDER BY ts NULLS LAST, seq ROWS UNBOUNDED PRECEDING))"""

RULE_SQL = {
    "flood_detection": ("Message Flood Attack", "HIGH", "BLOCK", "messages > 100", "'Client exceeded 100 messages'"),
    "topic_enumeration": ("Topic Enumeration Attack", "MEDIUM", "ALERT", "topics > 20",
                          "'Client accessed ' || topics || ' unique topics'"),
    "wildcard_abuse": ("Wildcard Subscription Abuse", "MEDIUM", "ALERT", "contains(topic, '#') OR contains(topic, '*')",
                       "'Wildcard pattern detected: ' || CASE WHEN contains(topic, '#') THEN '#' ELSE '*' END"),
    "payload_anomaly": ("Payload Anomaly Attack", "MEDIUM", "ALERT", "topic IS NOT NULL AND (size > 10000 OR size < 1)",
                        "'Anomalous payload size: ' || size || ' bytes'"),
    "qos_abuse": ("QoS Level Abuse", "LOW", "MONITOR", "topic IS NOT NULL AND qos2 > 50",
                  "'Excessive QoS 2 usage: ' || qos2 || ' messages'"),
    "system_topic_access": ("Unauthorized System Topic Access", "HIGH", "BLOCK", "starts_with(topic, '$SYS/')",
                            "'Access to system topic: $SYS/'"),
    "retain_abuse": ("Retain Message Abuse", "MEDIUM", "ALERT",
                     "topic IS NOT NULL AND retained = 1 AND retained_count > 100",
                     "'Excessive retain messages: ' || retained_count"),
}


def alert_select(key: str) -> str:
    name, severity, action, condition, description = RULE_SQL[key]
    return f"""SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", '{name}' AS rule_name,
      '{severity}' AS severity, client_id, topic, {description} AS description, '{action}' AS action,
      {str(action == 'BLOCK').lower()} AS blocked FROM running WHERE {condition}"""


def alerts_sql(*keys: str) -> str:
    return "alerts AS (" + " UNION ALL ".join(alert_select(k) for k in keys or RULE_SQL) + ")"


def _features(t: Tables) -> DataFrame:
    return message_fields(t.traffic.select(
        "ts", "client_id", "src_ip", "topic", "payload", "qos", "retain", "dupflag", "msgid", "label", "seq"))


def _register_rule(key: str) -> None:
    @query(key, f"WITH {RUNNING}, {alerts_sql(key)} SELECT * FROM alerts", "traffic")
    def one_rule(t: Tables) -> DataFrame:
        return detection.detect(_features(t), checks=[key], keep=("seq",))


for _key in RULE_SQL:
    _register_rule(_key)


@query("detect", f"WITH {RUNNING}, {alerts_sql()} SELECT * FROM alerts", "traffic")
def detect_all(t: Tables) -> DataFrame:
    return detection.detect(_features(t), keep=("seq",))


@query("detect_sliced", f"WITH {RUNNING}, {alerts_sql()} SELECT * FROM alerts", "traffic")
def detect_sliced(t: Tables) -> DataFrame:
    """The same with dominant clients cut into slices."""
    return detection.detect(_features(t), keep=("seq",), max_rows=100)


@query("detect_once_per_client", f"""
    WITH {RUNNING}, {alerts_sql()}, placed AS (SELECT alerts.*, row_number() OVER (
      PARTITION BY alerts.client_id, rule_name ORDER BY ts NULLS LAST, seq) AS place
      FROM alerts JOIN (SELECT seq, ts FROM traffic) USING (seq))
    SELECT seq, "timestamp", rule_name, severity, client_id, topic, description, action, blocked
    FROM placed WHERE place = 1""", "traffic")
def detect_once_per_client(t: Tables) -> DataFrame:
    return detection.detect(_features(t), once_per_client=True, keep=("seq",))


@query("client_stats", """
    SELECT client_id, count(*) AS message_count,
      count(DISTINCT topic) + max(CASE WHEN topic IS NULL THEN 1 ELSE 0 END) AS topic_count,
      epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen,
      min(length(payload)) AS min_payload_length, max(length(payload)) AS max_payload_length,
      round(avg(length(payload)), 4) AS avg_payload_length, count(*) FILTER (qos = 2) AS qos2_count
    FROM traffic GROUP BY client_id""", "traffic")
def client_stats(t: Tables) -> DataFrame:
    return detection.client_stats(_features(t)).withColumns({
        "first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen"),
        "avg_payload_length": F.round("avg_payload_length", 4)})


@query("high_severity", f"""
    WITH {RUNNING}, {alerts_sql()} SELECT * FROM alerts WHERE severity IN ('HIGH', 'CRITICAL')""", "traffic")
def high_severity(t: Tables) -> DataFrame:
    return detection.high_severity(detect_all(t))


def summary_sql(latest: str) -> str:
    return f"""
    WITH {RUNNING}, {alerts_sql()}, latest AS ({latest})
    SELECT 'severity' AS dimension, severity AS name, count(*) AS alerts FROM latest GROUP BY severity
    UNION ALL SELECT 'action', action, count(*) FROM latest GROUP BY action
    UNION ALL SELECT 'clients', 'analyzed', count(DISTINCT client_id) FROM traffic"""


@query("alert_summary", summary_sql("SELECT * FROM alerts"), "traffic")
def alert_summary(t: Tables) -> DataFrame:
    return detection.alert_summary(detect_all(t), None, t.traffic)


# checks of one row, in order
RULE_PLACES = " ".join(f"WHEN '{RULE_SQL[key][0]}' THEN {i}" for i, key in enumerate((
    "flood_detection", "topic_enumeration", "wildcard_abuse", "payload_anomaly", "qos_abuse", "system_topic_access",
    "retain_abuse")))


@query("alert_summary_latest", summary_sql(f"""
    SELECT * FROM alerts ORDER BY "timestamp" DESC NULLS FIRST, seq DESC, CASE rule_name {RULE_PLACES} END DESC
    LIMIT 1000"""), "traffic")
def alert_summary_latest(t: Tables) -> DataFrame:
    """The report over the latest 1,000 alerts."""
    return detection.alert_summary(detect_all(t), 1000, t.traffic)


@query("write_alerts", f"""
    WITH {RUNNING}, {alerts_sql('wildcard_abuse', 'payload_anomaly', 'system_topic_access')}
    SELECT "timestamp", rule_name, severity, client_id, topic, description, action, blocked FROM alerts""", "traffic")
def write_alerts(t: Tables) -> DataFrame:
    """Alerts appended in two runs to one CSV table, then read back."""
    alerts = detection.detect_stateless(_features(t))
    path = scratch_path(t.spark, "alerts")
    tables.write_alerts(detection.high_severity(alerts), path)
    tables.write_alerts(alerts.where(~F.col("severity").isin("HIGH", "CRITICAL")), path)
    return tables.read_alerts(t.spark, path)


# --- detection per time window; thresholds fit the sparse events ---

WINDOW_RULES = Rules().override(
    flood_detection={"threshold": 5, "window_seconds": 3600},
    topic_enumeration={"threshold": 4, "window_seconds": 3600},
    qos_abuse={"threshold": 6, "window_seconds": 43200},
    retain_abuse={"threshold": 6, "window_seconds": 43200},
    reconnect_storm={"threshold": 1, "window_seconds": 3600},
    duplicate_client={"threshold": 1, "window_seconds": 3600},
)
WINDOW_SQL = {
    "flood_detection": (3600, 5, "count(*)"),
    "topic_enumeration": (3600, 4, "count(DISTINCT coalesce(topic, '-'))"),
    "qos_abuse": (43200, 6, "count(*) FILTER (qos = 2)"),
    "retain_abuse": (43200, 6, "count(*) FILTER (retain = 1)"),
    "reconnect_storm": (3600, 1, "count(*) FILTER (packet_type = 'CONNECT')"),
    "duplicate_client": (3600, 1, "count(DISTINCT src_ip)"),
}
WINDOW_NAMES = {key: (r.name, r.severity, r.action, r.blocked) for key, r in WINDOW_RULES.table.items()}


def window_select(key: str, closed: str = "true") -> str:
    seconds, threshold, measure = WINDOW_SQL[key]
    name, severity, action, blocked = WINDOW_NAMES[key]
    start = f"epoch_us(ts) // {seconds}000000 * {seconds}000000"
    return f"""SELECT client_id, '{name}' AS rule_name, '{severity}' AS severity, '{action}' AS action,
      {str(blocked).lower()} AS blocked, {start} AS window_start, {measure} AS observed
      FROM traffic WHERE ts IS NOT NULL AND {start} + {seconds}000000 <= {'1e18' if closed == 'true' else closed}
      GROUP BY client_id, {start} HAVING {measure} > {threshold}"""


def window_sql(*keys: str, closed: str = "true") -> str:
    return " UNION ALL ".join(window_select(k, closed) for k in keys)


def _flat_window(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("window_start", F.unix_micros("window_start"))


COUNTING = ("flood_detection", "topic_enumeration", "qos_abuse", "retain_abuse")


@query("detect_windowed", window_sql(*COUNTING), "traffic")
def detect_windowed(t: Tables) -> DataFrame:
    return _flat_window(windows.detect_windowed(_features(t), WINDOW_RULES))


@query("reconnect_storm", window_sql("reconnect_storm"), "traffic")
def reconnect_storm(t: Tables) -> DataFrame:
    return _flat_window(windows.reconnect_storm(t.traffic, WINDOW_RULES))


@query("duplicate_client", window_sql("duplicate_client"), "traffic")
def duplicate_client(t: Tables) -> DataFrame:
    return _flat_window(windows.duplicate_client(t.traffic, WINDOW_RULES))


def sliding_select(key: str) -> str:
    seconds, threshold, measure = WINDOW_SQL[key]
    name, severity, action, blocked = WINDOW_NAMES[key]
    over = (f"OVER (PARTITION BY client_id ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING "
            f"AND CURRENT ROW)")
    return f"""SELECT client_id, '{name}' AS rule_name, '{severity}' AS severity, '{action}' AS action,
      {str(blocked).lower()} AS blocked, epoch_us(ts) AS ts_us, observed FROM (
        SELECT *, {measure} {over} AS observed FROM traffic WHERE ts IS NOT NULL) WHERE observed > {threshold}"""


@query("detect_sliding", " UNION ALL ".join(sliding_select(k) for k in COUNTING), "traffic")
def detect_sliding(t: Tables) -> DataFrame:
    alerts = windows.detect_sliding(_features(t), WINDOW_RULES)
    return alerts.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query("detect_sliding_sliced", " UNION ALL ".join(sliding_select(k) for k in COUNTING), "traffic")
def detect_sliding_sliced(t: Tables) -> DataFrame:
    """The same with clients cut into slices of about 500 rows."""
    alerts = windows.detect_sliding(_features(t), WINDOW_RULES, max_rows=500)
    return alerts.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


# --- streams; the events arrive as files and everything there is gets processed ---

def _streamed(t: Tables, view: str) -> DataFrame:
    """A view over a stream of the events file."""
    events = message_source.message_stream(
        t.spark, t.folder, schema=t.table("events").schema, glob="events.parquet")
    return t.view(view, events)


def _traffic_stream(t: Tables) -> DataFrame:
    return _streamed(t, "traffic")


def _run(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    path, checkpoint = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-checkpoint")
    sinks.run_to_end(stream, path, checkpoint)
    return t.spark.read.schema(stream.schema).parquet(path)


@query("append_traffic_log", COLLECTED, "traffic")
def append_traffic_log(t: Tables) -> DataFrame:
    path, checkpoint = scratch_path(t.spark, "log"), scratch_path(t.spark, "log-checkpoint")
    arriving = as_messages(_traffic_stream(t))
    collect.append_traffic_log(
        arriving, path, checkpoint, keep=("device_type",), available_now=True).awaitTermination()
    return t.spark.read.parquet(path)


@query("message_stream", """
    SELECT coalesce(topic, 'lost') AS topic, qos, count(*) AS messages, CAST(sum(length(payload)) AS BIGINT) AS bytes
    FROM traffic GROUP BY ALL""", "traffic")
def message_stream(t: Tables) -> DataFrame:
    """Messages written as files in MESSAGE_SCHEMA, taken in by the source and counted."""
    arrivals = scratch_path(t.spark, "messages")
    t.messages.drop("seq").write.parquet(arrivals)
    received = _run(t, message_source.message_stream(t.spark, arrivals), "received")
    return received.groupBy("topic", "qos").agg(
        F.count("*").alias("messages"), F.sum(F.octet_length("payload")).cast("bigint").alias("bytes"))


DELAY = "10 minutes"
CLOSED = "(SELECT max(epoch_us(ts)) - 600000000 FROM traffic)"


@query("collection_stats_stream", f"""
    SELECT epoch_us(ts) // 10000000 * 10000000 AS interval_start, count(*) AS messages, count(*) / 10 AS messages_per_sec
    FROM traffic WHERE ts IS NOT NULL
      AND epoch_us(ts) // 10000000 * 10000000 + 10000000 <= {CLOSED} GROUP BY 1""", "traffic")
def collection_stats_stream(t: Tables) -> DataFrame:
    stream = collect.stats_stream(_traffic_stream(t), DELAY)
    return _run(t, stream, "intervals").withColumn("interval_start", F.unix_micros("interval_start"))


@query("detect_stream", f"""
    WITH {RUNNING}, {alerts_sql('wildcard_abuse', 'payload_anomaly', 'system_topic_access')}
    SELECT "timestamp", rule_name, severity, client_id, topic, description, action, blocked FROM alerts""", "traffic")
def detect_stream(t: Tables) -> DataFrame:
    return _run(t, detect.row_alerts(message_fields(_traffic_stream(t))), "row-alerts")


@query("detect_stream_cumulative", f"""
    WITH {RUNNING}, {alerts_sql("flood_detection", "topic_enumeration", "qos_abuse", "retain_abuse")}
    SELECT * FROM alerts""", "traffic")
def detect_stream_cumulative(t: Tables) -> DataFrame:
    rows = message_fields(_traffic_stream(t))
    return _run(t, detect.cumulative_alerts(rows, keep=("seq",)), "cumulative-alerts")


@query("detect_stream_windowed", window_sql(*COUNTING, closed=CLOSED), "traffic")
def detect_stream_windowed(t: Tables) -> DataFrame:
    stream = detect.window_alerts(message_fields(_traffic_stream(t)), WINDOW_RULES, DELAY)
    return _flat_window(_run(t, stream, "window-alerts"))


@query("detect_stream_connections", window_sql("reconnect_storm", "duplicate_client", closed=CLOSED), "traffic")
def detect_stream_connections(t: Tables) -> DataFrame:
    return _flat_window(_run(t, detect.connection_alerts(_traffic_stream(t), WINDOW_RULES, DELAY), "connections"))


# --- attack logs ---

@query("check_required_fields", """
    SELECT 'Publish Flood' AS attack, count(*) AS entries, '' AS missing, count(topic) AS topics_filled, true AS compliant
      FROM flood_log
    UNION ALL SELECT 'Brute Force', count(*), 'src_ip,connack_reason', NULL, false FROM flood_log
    """, "flood_log")
def check_required_fields(t: Tables) -> DataFrame:
    log = t.view("flood_log")
    both = logs.check_required_fields(log, "Publish Flood").unionByName(
        logs.check_required_fields(log.drop("src_ip"), "Brute Force"))
    filled = F.get(F.filter("filled", lambda f: f["field"] == "topic"), F.lit(0))["filled"]
    return both.select("attack", "entries", F.array_join("missing", ",").alias("missing"),
                       filled.alias("topics_filled"), "compliant")


@query("compliance_summary", """
    WITH logs AS (SELECT 'Publish Flood' AS attack, count(*) AS entries, CAST(1 AS BIGINT) AS compliant_logs FROM flood_log
      UNION ALL SELECT 'Wildcard Abuse', count(*), 1 FROM wildcard_log
      UNION ALL SELECT 'Brute Force', count(*), 0 FROM flood_log
      UNION ALL SELECT 'QoS 2 Abuse', count(*), 1 FROM qos2_log)
    SELECT attack, entries, compliant_logs, CAST(1 AS BIGINT) AS logs FROM logs
    UNION ALL SELECT 'overall', CAST(sum(entries) AS BIGINT), CAST(sum(compliant_logs) AS BIGINT), count(*) FROM logs
    """, "flood_log", "wildcard_log", "qos2_log")
def compliance_summary(t: Tables) -> DataFrame:
    return logs.compliance_summary({
        "Publish Flood": t.view("flood_log"), "Wildcard Abuse": t.view("wildcard_log"),
        "Brute Force": t.view("flood_log"), "QoS 2 Abuse": t.view("qos2_log")})


@query("flood_stats", "SELECT client_id, count(*) AS messages FROM flood_log GROUP BY client_id", "flood_log")
def flood_stats(t: Tables) -> DataFrame:
    return logs.flood_stats(t.view("flood_log"))


@query("bruteforce_stats", """
    SELECT count(*) FILTER (packet_type = 'SUBACK' AND status = 'granted') AS granted,
      count(*) FILTER (packet_type = 'SUBACK' AND status = 'denied') AS denied,
      count(*) FILTER (packet_type = 'CONNECT' AND status = 'success') AS connected,
      count(*) FILTER (packet_type = 'CONNECT' AND status = 'failed') AS refused,
      round(avg(latency_ms) FILTER (packet_type = 'SUBACK'), 4) AS avg_latency_ms,
      quantile_disc(latency_ms, 0.95) FILTER (packet_type = 'SUBACK') AS p95_latency_ms,
      max(latency_ms) FILTER (packet_type = 'SUBACK') AS max_latency_ms FROM bruteforce_log""", "bruteforce_log")
def bruteforce_stats(t: Tables) -> DataFrame:
    return logs.bruteforce_stats(t.view("bruteforce_log")).withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))


# sketches of single hours are stored and merged; what they say is held against the ranks of all latencies
@query("bruteforce_latency", """
    SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS quantile, latencies, true AS within_one_percent
    FROM (SELECT count(latency_ms) AS latencies FROM bruteforce_log WHERE packet_type = 'SUBACK')""", "bruteforce_log")
def bruteforce_latency(t: Tables) -> DataFrame:
    log, path = t.view("bruteforce_log"), scratch_path(t.spark, "latency-sketches")
    logs.latency_sketches(log.withColumn("hour", F.hour("ts")), "hour").write.parquet(path)
    found = logs.merged_latency(t.spark.read.parquet(path))
    exact = log.where("packet_type = 'SUBACK'").select("latency_ms")
    below, up_to = F.count_if(F.col("exact.latency_ms") < F.col("found.latency_ms")), F.count_if(
        F.col("exact.latency_ms") <= F.col("found.latency_ms"))
    at = F.col("quantile") * F.col("latencies")
    return (exact.alias("exact").join(F.broadcast(found).alias("found"))  # three rows
            .groupBy("quantile", "latencies").agg(below.alias("below"), up_to.alias("up_to"))
            .select("quantile", "latencies", (
                (F.col("below") - at <= F.col("latencies") / 100) & (at - F.col("up_to") <= F.col("latencies") / 100))
                .alias("within_one_percent")))


@query("enumeration_stats", """
    SELECT count(*) FILTER (action IN ('subscribe_attempt', 'wildcard_subscribe') AND status IN ('subscribed', 'failed'))
        AS subscription_attempts,
      count(*) FILTER (action = 'subscribe_attempt' AND status = 'subscribed') AS successful_subscriptions,
      count(*) FILTER (action IN ('message_received', 'wildcard_message')) AS received_messages,
      count(DISTINCT topic) FILTER (action IN ('message_received', 'wildcard_message')) AS discovered_topics
    FROM topic_enumeration_log""", "topic_enumeration_log")
def enumeration_stats(t: Tables) -> DataFrame:
    return logs.enumeration_stats(t.view("topic_enumeration_log"))


@query("discovered_topics", """
    SELECT DISTINCT topic FROM topic_enumeration_log WHERE action IN ('message_received', 'wildcard_message')
    ORDER BY topic""", "topic_enumeration_log")
def discovered_topics(t: Tables) -> DataFrame:
    return logs.discovered_topics(t.view("topic_enumeration_log"))


@query("duplicate_id_stats", """
    SELECT count(*) FILTER (action = 'connect_attempt' AND status IN ('connected', 'failed')) AS connection_attempts,
      count(*) FILTER (action = 'connect_attempt' AND status = 'connected') AS successful_connections,
      count(*) FILTER (action = 'disconnect') AS disconnections,
      count(*) FILTER (action = 'connect_attempt' AND status = 'connected' AND session_present = 'True')
        AS counted_conflicts,
      count(*) FILTER (conflict_detected = 'True') AS flagged_conflicts FROM duplicate_id_log""", "duplicate_id_log")
def duplicate_id_stats(t: Tables) -> DataFrame:
    return logs.duplicate_id_stats(t.view("duplicate_id_log"))


QOS2_PAIRING = """
    WITH steps AS (SELECT *, lag(handshake_step) OVER place AS before, lag(ts) OVER place AS before_ts FROM qos2_log
      WHERE (action = 'publish' AND handshake_step = 'PUBLISH') OR handshake_step = 'PUBCOMP'
      WINDOW place AS (PARTITION BY client_id, message_id ORDER BY ts NULLS LAST, seq))
    SELECT client_id, message_id, seq, coalesce(before, '') <> 'PUBLISH' AS unexpected,
      CASE WHEN before = 'PUBLISH' THEN round((epoch_us(ts) - epoch_us(before_ts)) / 1000000, 6) END AS handshake_sec
    FROM steps WHERE handshake_step = 'PUBCOMP'"""


@query("qos2_pairing", QOS2_PAIRING, "qos2_log")
def qos2_pairing(t: Tables) -> DataFrame:
    return logs.qos2_pairing(t.view("qos2_log")).drop("ts").withColumn("handshake_sec", F.round("handshake_sec", 6))


@query("qos2_pairing_sliced", QOS2_PAIRING, "qos2_log")
def qos2_pairing_sliced(t: Tables) -> DataFrame:
    """The same with message ids cut into slices of a few rows."""
    return logs.qos2_pairing(t.view("qos2_log"), max_rows=2).drop("ts").withColumn("handshake_sec", F.round("handshake_sec", 6))


@query("qos2_pairing_stream", QOS2_PAIRING, "qos2_log")
def qos2_pairing_stream(t: Tables) -> DataFrame:
    paired = _run(t, handshakes.qos2_pairing_stream(_streamed(t, "qos2_log")), "handshakes")
    return paired.drop("ts").withColumn("handshake_sec", F.round("handshake_sec", 6))


QOS2_STATS = """
    SELECT *, round(pubcomp / published * 100, 4) AS completion_percent FROM (
      SELECT count(*) FILTER (action = 'publish' AND handshake_step = 'PUBLISH') AS published,
        count(*) FILTER (action IN ('message_received', 'qos2_message_received')) AS received,
        count(*) FILTER (handshake_step = 'PUBREC') AS pubrec, count(*) FILTER (handshake_step = 'PUBCOMP') AS pubcomp,
        count(*) FILTER (action = 'publish' AND status = 'failed') AS failures,
        round(avg(TRY_CAST(regexp_extract(details, 'duration=([0-9.]+)s', 1) AS DOUBLE))
          FILTER (action = 'mixed_handshake'), 4) AS mixed_handshake_sec FROM qos2_log)"""


def _rounded_qos2(log: DataFrame) -> DataFrame:
    return logs.qos2_stats(log).withColumns({
        "completion_percent": F.round("completion_percent", 4),
        "mixed_handshake_sec": F.round("mixed_handshake_sec", 4)})


@query("qos2_stats", QOS2_STATS, "qos2_log")
def qos2_stats(t: Tables) -> DataFrame:
    return _rounded_qos2(t.view("qos2_log"))


@query("read_attack_log", QOS2_STATS, "qos2_log")
def read_attack_log(t: Tables) -> DataFrame:
    """The QoS 2 log written as its CSV, read with its schema and summarised."""
    path = scratch_path(t.spark, "qos2-log")
    t.view("qos2_log").drop("seq", "ts").write.options(**tables.READ_OPTIONS).csv(path)
    return _rounded_qos2(tables.read_attack_log(t.spark, path, "qos2"))


def _register_log(kind: str) -> None:
    kinds = dict(column.split() for column in ATTACK_LOG_SCHEMAS[kind].split(", "))
    view = f"{kind}_log"
    # an empty cell and an empty text are the same in a CSV file
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" if k == "STRING" else c for c, k in kinds.items())

    @query(f"read_attack_log_{kind}", f"SELECT {cells}, epoch_us(ts) AS ts_us FROM {view}", view)
    def one_log(t: Tables) -> DataFrame:
        """A log written as its CSV and read with its schema: every cell, and the time."""
        path = scratch_path(t.spark, view)
        t.view(view).select(*kinds).write.options(**tables.READ_OPTIONS).csv(path)
        read = tables.read_attack_log(t.spark, path, kind)
        return read.select(*[F.coalesce(c, F.lit("")).alias(c) if k == "STRING" else c for c, k in kinds.items()],
                           F.unix_micros("ts").alias("ts_us"))


for _kind in ATTACK_LOG_SCHEMAS:
    _register_log(_kind)


@query("reconnect_stats", """
    SELECT connections, disconnections, failures, ok - disconnections AS active,
      round((connections - failures) / connections * 100, 4) AS success_percent FROM (
      SELECT count(*) FILTER (action IN ('connect', 'bomb_connect') AND status IN ('success', 'failed')) AS connections,
        count(*) FILTER (action IN ('disconnect', 'bomb_disconnect')) AS disconnections,
        count(*) FILTER (action IN ('connect', 'bomb_connect') AND status = 'success') AS ok,
        count(*) FILTER ((action IN ('connect', 'bomb_connect') AND status = 'failed')
          OR (action = 'connect' AND status = 'exception')) AS failures FROM reconnect_log)""", "reconnect_log")
def reconnect_stats(t: Tables) -> DataFrame:
    return logs.reconnect_stats(t.view("reconnect_log")).withColumn("success_percent", F.round("success_percent", 4))


SENT = """((attack_type = 'retain_flood' AND status = 'sent')
      OR (attack_type IN ('qos2_abuse', 'mixed_qos_retain') AND status IN ('sent', 'failed')))"""


@query("retain_qos_stats", f"""
    SELECT count(*) FILTER {SENT} AS sent,
      count(DISTINCT topic) FILTER (attack_type = 'retain_flood' AND status = 'sent') AS retained_topics
    FROM retain_qos_log""", "retain_qos_log")
def retain_qos_stats(t: Tables) -> DataFrame:
    return logs.retain_qos_stats(t.view("retain_qos_log"))


@query("retain_qos_rate", f"""
    SELECT epoch_us(ts) // 10000000 * 10000000 AS interval_start, count(*) AS sent, count(*) / 10 AS messages_per_sec
    FROM retain_qos_log WHERE ts IS NOT NULL AND {SENT} GROUP BY 1""", "retain_qos_log")
def retain_qos_rate(t: Tables) -> DataFrame:
    return logs.retain_qos_rate(t.view("retain_qos_log")).withColumn("interval_start", F.unix_micros("interval_start"))


@query("payload_anomaly_stats", """
    WITH kinds AS (SELECT CASE WHEN anomaly_type = 'homemade' THEN 'other' ELSE anomaly_type END AS anomaly_type, status
      FROM payload_anomaly_log)
    SELECT coalesce(anomaly_type, 'all') AS anomaly_type, count(*) FILTER (status = 'sent') AS sent,
      count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS error
    FROM kinds GROUP BY GROUPING SETS ((anomaly_type), ())""", "payload_anomaly_log")
def payload_anomaly_stats(t: Tables) -> DataFrame:
    return logs.payload_anomaly_stats(t.view("payload_anomaly_log"))


# --- cameras ---

PARSED = """parsed AS (SELECT seq, topic, payload, p[2] AS zone, p[4] AS camera_id, p[5] AS message_type,
    CASE WHEN contains(topic, 'status') THEN 'status' WHEN contains(topic, 'motion') THEN 'motion'
      WHEN contains(topic, 'stream') THEN 'stream' WHEN contains(topic, 'security') THEN 'security'
      WHEN contains(topic, 'system') THEN 'system' END AS camera_class
  FROM (SELECT *, string_split(topic, '/') AS p FROM camera) WHERE len(p) >= 5 AND json_valid(payload))"""


@query("parse_camera_topic", f"WITH {PARSED} SELECT seq, zone, camera_id, message_type FROM parsed", "camera")
def parse_camera_topic(t: Tables) -> DataFrame:
    return camera.parse_camera_topic(t.view("camera")).select("seq", "zone", "camera_id", "message_type")


@query("route_camera", f"WITH {PARSED} SELECT seq, camera_class FROM parsed", "camera")
def route_camera(t: Tables) -> DataFrame:
    return camera.route_camera(t.view("camera")).select("seq", "camera_class")


@query("camera_stats", f"""
    WITH {PARSED}, known AS (SELECT unnest(['status', 'motion', 'stream', 'security', 'system']) AS camera_class)
    SELECT camera_class, count(seq) AS messages FROM known LEFT JOIN parsed USING (camera_class) GROUP BY camera_class
    UNION ALL SELECT 'total', count(*) FROM parsed""", "camera")
def camera_stats(t: Tables) -> DataFrame:
    return camera.camera_stats(t.view("camera"))


# field, SQL type and default of what each class shows
CAMERA_SQL = {
    "status": [("status", "VARCHAR", "'unknown'"), ("temperature", "DOUBLE", "0"), ("cpu_usage", "DOUBLE", "0"),
               ("recording", "BOOLEAN", "false")],
    "motion": [("confidence", "DOUBLE", "0"), ("motion_area_percent", "DOUBLE", "0"),
               ("alert_level", "VARCHAR", "'unknown'")],
    "security": [("event_type", "VARCHAR", "'unknown'"), ("severity", "VARCHAR", "'info'"), ("confidence", "DOUBLE", "0")],
    "system": [("event_type", "VARCHAR", "'unknown'"), ("requires_attention", "BOOLEAN", "false")],
    "stream": [("current_fps", "INTEGER", "0"), ("bitrate_kbps", "INTEGER", "0"), ("quality_score", "DOUBLE", "0")],
}


def _register_camera(name: str) -> None:
    shown = ", ".join(
        f"coalesce(CAST(json_extract_string(payload, '$.{field}') AS {kind}), {default}) AS {field}"
        for field, kind, default in CAMERA_SQL[name])

    @query(f"camera_{name}", f"""
        WITH {PARSED} SELECT seq, zone, camera_id, {shown} FROM parsed WHERE camera_class = '{name}'""", "camera")
    def fields(t: Tables) -> DataFrame:
        return camera.camera_fields(t.view("camera"), name, keep=("seq",))


for _name in CAMERA_SQL:
    _register_camera(_name)


# --- report ---

@query("pipeline_report", f"""
    WITH {RUNNING}, {alerts_sql('system_topic_access')}
    SELECT 'Canonical Dataset' AS artefact, 'OK' AS status, count(*) AS records FROM traffic WHERE ts IS NOT NULL
    UNION ALL SELECT 'Collected Traffic', 'OK', count(*) FROM traffic
    UNION ALL SELECT 'Extracted Features', 'MISSING', NULL
    UNION ALL SELECT 'Security Alerts', 'OK', count(*) FROM alerts""", "traffic")
def pipeline_report(t: Tables) -> DataFrame:
    """A run that left three of its four tables."""
    paths = {name: scratch_path(t.spark, name.lower().replace(" ", "-")) for name in report.ARTEFACTS}
    tables.write_table(t.traffic.where(F.col("ts").isNotNull()).select("seq", "topic"), paths["Canonical Dataset"])
    tables.write_table(t.traffic.select("seq", "topic"), paths["Collected Traffic"])
    tables.write_table(detection.detect(_features(t), checks=["system_topic_access"]), paths["Security Alerts"])
    return report.pipeline_report(t.spark, paths)
