"""Device traffic seen in the supplied ``events`` table.

Each view is one SELECT that Spark and the checking engine both understand, so both sides start from the same
rows; only the few functions in ``DIALECTS`` differ. A third of all messages belongs to one client.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.session import configure

DIALECTS = {
    "spark": {"us": "unix_micros(CAST(ts AS TIMESTAMP))", "ts": "CAST(ts AS TIMESTAMP)"},
    "oracle": {"us": "epoch_us(ts)", "ts": "ts"},
}

VIEWS = {
    # messages as a collector or packet capture would see them
    "traffic": {
        "seq": "event_id",
        "ts": "CASE WHEN event_id % 61 <> 0 THEN {ts} END",
        "ts_text": """
            CASE WHEN event_id % 61 = 0 THEN 'bad' ELSE CAST(CAST(floor({us} / 1000000) AS BIGINT) AS
            STRING) || '.' || lpad(CAST({us} % 1000000 AS STRING), 6, '0') END""",
        "client_id": """
            CASE WHEN event_id % 3 = 1 THEN 'gateway' ELSE 'user_' || CAST(user_id AS STRING) END""",
        "src_ip": """
            '10.0.' || CAST(event_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING)""",
        "topic": """
            CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 89 = 0 THEN '$SYS/broker/' || event_type
            WHEN event_id % 97 = 0 THEN 'site/' || event_type || '/#' WHEN event_id % 79 = 0 THEN 'Door Lock' ELSE 'site/canonical/' || event_type || '/device_' || lpad(CAST(user_id % 5 + 1 AS
            STRING), 3, '0') || '/telemetry' END""",
        "qos": "CAST((event_id % 5) % 3 AS INT)",
        "retain": "CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INT)",
        "dupflag": "CAST(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS INT)",
        "payload": """
            CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 6 = 0 THEN props WHEN event_id % 6 = 1 THEN
            '{{"device_id": "dev_' || CAST(user_id AS STRING) || '", "value": ' || CAST(value AS STRING) ||
            '}}' WHEN event_id % 6 = 2 THEN '{{"unit": "c", "temp": ' || CAST(value AS STRING) || ', "ok": true}}' WHEN event_id % 6 = 3 THEN CAST(value AS STRING) WHEN event_id % 6 = 4 THEN event_type
            || ' fire  alarm' ELSE '{{"client_id": "c_' || CAST(user_id AS STRING) || '", "device_type": "Fan", "flag": true, "n": "7"}}' END""",
        "packet_code": "CAST(event_id % 17 AS STRING)",
        "packet_type": "CASE WHEN event_id % 4 = 1 THEN 'CONNECT' ELSE 'PUBLISH' END",
        "protocol": """
            CASE WHEN event_id % 10 = 9 THEN 'coap' WHEN event_id % 50 = 3 THEN 'ftp' ELSE 'mqtt' END""",
        "msgid": "CASE WHEN (event_id % 5) % 3 > 0 THEN event_id % 65536 END",
        "label": """
            CASE WHEN event_type = 'error' THEN 'attack' WHEN event_type = 'view' THEN '' ELSE 'normal' END""",
        "user_id": "user_id",
        "event_type": "event_type",
        "value": "value",
    },
    # the same rows under the headers of a packet capture
    "capture": {
        "seq": "seq",
        "frame.time_epoch": "ts_text",
        "ip.src": "src_ip",
        "ip.dst": "'10.1.0.1'",
        "tcp.srcport": "CAST(40000 + user_id % 1000 AS STRING)",
        "tcp.dstport": "'1883'",
        "mqtt.clientid": "CASE WHEN seq % 11 <> 0 THEN client_id END",
        "mqtt.topic": "topic",
        "mqtt.qos": "CAST(qos AS STRING)",
        "mqtt.retain": "CASE WHEN retain = 1 THEN 'True' ELSE 'false' END",
        "mqtt.dupflag": "CAST(dupflag AS STRING)",
        "mqtt.msgtype": "packet_code",
        "mqtt.protoname": "protocol",
        "mqtt.msgid": "CAST(msgid AS STRING)",
        "mqtt.msg": "CASE WHEN seq % 9 = 0 THEN payload ELSE lower(hex(payload)) END",
        "mqtt.len": "CAST(length(payload) AS STRING)",
        "label": "label",
    },
    # the same rows under plain headers
    "plain": {
        "seq": "seq",
        "timestamp": "ts_text",
        "src_ip": "src_ip",
        "src_port": "'50000'",
        "dst_ip": "'10.1.0.1'",
        "dst_port": "'1883'",
        "client_id": "client_id",
        "topic": "topic",
        "qos": "CAST(qos AS STRING)",
        "retain": "CAST(retain AS STRING)",
        "payload": "payload",
        "packet_type": "packet_type",
        "protocol": "protocol",
        "label": "label",
    },
    # the nine attack logs, read off the traffic
    "flood_log": {
        "seq": "seq",
        "ts": "ts",
        "timestamp": "ts_text",
        "client_id": "client_id",
        "src_ip": "src_ip",
        "topic": "topic",
        "packet_type": "packet_type",
        "payload_length": "CAST(length(payload) AS INT)",
        "qos": "qos",
        "mid": "msgid",
        "result": "CAST(seq % 2 AS INT)",
    },
    "wildcard_log": {
        "ts": "ts",
        "timestamp": "ts_text",
        "client_id": "client_id",
        "packet_type": "packet_type",
        "topic": "topic",
        "payload": "payload",
        "details": "'len'",
    },
    "bruteforce_log": {
        "ts": "ts",
        "timestamp": "ts_text",
        "packet_type": """
            CASE WHEN seq % 4 = 0 THEN 'CONNECT' WHEN seq % 4 = 3 THEN 'message' ELSE 'SUBACK' END""",
        "client_id": "client_id",
        "src_ip": "src_ip",
        "topic": "topic",
        "connack_reason": "CASE WHEN seq % 5 = 0 THEN 'Error_5' ELSE 'Success' END",
        "status": """
            CASE WHEN seq % 4 = 0 THEN CASE WHEN seq % 5 = 0 THEN 'failed' ELSE 'success' END WHEN seq % 3 =
            0 THEN 'denied' ELSE 'granted' END""",
        "latency_ms": "CASE WHEN seq % 4 IN (1, 2) THEN value END",
    },
    "payload_anomaly_log": {
        "ts": "ts",
        "timestamp_utc": "ts_text",
        "client_id": "client_id",
        "topic": "topic",
        "anomaly_type": """
            CASE event_type WHEN 'click' THEN 'oversized_payload' WHEN 'view' THEN 'malformed_json' WHEN
            'error' THEN 'null_bytes' WHEN 'signup' THEN 'binary_data' ELSE 'homemade' END""",
        "payload_size": "CAST(length(payload) AS INT)",
        "status": """
            CASE WHEN seq % 10 = 0 THEN 'error' WHEN seq % 10 = 1 THEN 'failed' ELSE 'sent' END""",
        "error_msg": "''",
    },
    "retain_qos_log": {
        "ts": "ts",
        "timestamp_utc": "ts_text",
        "client_id": "client_id",
        "topic": "topic",
        "attack_type": """
            CASE seq % 5 WHEN 0 THEN 'retain_flood' WHEN 1 THEN 'qos2_abuse' WHEN 2 THEN 'mixed_qos_retain'
            WHEN 3 THEN 'retain_create' ELSE 'retain_clear' END""",
        "qos": "qos",
        "retain": "CASE WHEN retain = 1 THEN 'True' ELSE 'False' END",
        "payload_size": "CAST(length(payload) AS INT)",
        "status": """
            CASE WHEN seq % 9 = 0 THEN 'error' WHEN seq % 9 = 1 THEN 'failed' ELSE 'sent' END""",
        "details": "''",
    },
    "topic_enumeration_log": {
        "ts": "ts",
        "timestamp_utc": "ts_text",
        "client_id": "client_id",
        "topic": "topic",
        "action": """
            CASE seq % 4 WHEN 0 THEN 'subscribe_attempt' WHEN 1 THEN 'wildcard_subscribe' WHEN 2 THEN
            'message_received' ELSE 'wildcard_message' END""",
        "qos": "qos",
        "status": """
            CASE WHEN seq % 4 > 1 THEN 'success' WHEN seq % 9 = 0 THEN 'error' WHEN seq % 7 = 0 THEN
            'failed' ELSE 'subscribed' END""",
        "payload_preview": "payload",
        "details": "''",
    },
    "duplicate_id_log": {
        "ts": "ts",
        "timestamp_utc": "ts_text",
        "client_id": "client_id",
        "action": """
            CASE seq % 3 WHEN 0 THEN 'connect_attempt' WHEN 1 THEN 'disconnect' ELSE 'takeover_attempt' END""",
        "status": """
            CASE WHEN seq % 3 = 1 THEN CASE WHEN seq % 2 = 0 THEN 'voluntary' ELSE 'involuntary' END WHEN
            seq % 10 = 0 THEN 'failed' WHEN seq % 10 = 1 THEN 'exception' ELSE 'connected' END""",
        "return_code": "0",
        "session_present": "CASE WHEN seq % 4 = 0 THEN 'True' ELSE 'False' END",
        "details": "''",
        "conflict_detected": "CASE WHEN seq % 4 = 0 OR seq % 6 = 1 THEN 'True' ELSE 'False' END",
    },
    "reconnect_log": {
        "ts": "ts",
        "timestamp_utc": "ts_text",
        "client_id": "client_id",
        "worker_id": "CAST(user_id % 8 AS STRING)",
        "action": """
            CASE seq % 4 WHEN 0 THEN 'connect' WHEN 1 THEN 'disconnect' WHEN 2 THEN 'bomb_connect' ELSE
            'bomb_disconnect' END""",
        "status": """
            CASE WHEN seq % 2 = 1 THEN 'voluntary' WHEN seq % 11 = 0 THEN 'exception' WHEN seq % 7 = 0 THEN
            'failed' ELSE 'success' END""",
        "return_code": "0",
        "connection_time": "value",
        "session_duration": "0.0",
        "details": "''",
    },
    "qos2_log": {
        "seq": "seq",
        "ts": "ts",
        "timestamp_utc": "ts_text",
        "client_id": "client_id",
        "worker_id": "CAST(user_id % 8 AS STRING)",
        "message_id": "user_id % 20",
        "topic": "topic",
        "action": """
            CASE seq % 7 WHEN 0 THEN 'publish' WHEN 1 THEN 'publish' WHEN 2 THEN 'qos2_handshake' WHEN 3
            THEN 'qos2_handshake' WHEN 4 THEN 'message_received' WHEN 5 THEN 'qos2_message_received' ELSE
            'mixed_handshake' END""",
        "qos": "qos",
        "payload_size": "CAST(length(payload) AS INT)",
        "handshake_step": """
            CASE WHEN seq % 7 < 2 AND seq % 10 <> 0 THEN 'PUBLISH' WHEN seq % 7 = 2 THEN 'PUBREC' WHEN seq %
            7 = 3 THEN 'PUBCOMP' ELSE '' END""",
        "status": "CASE WHEN seq % 7 < 2 AND seq % 10 = 0 THEN 'failed' ELSE 'sent' END",
        "details": """
            CASE WHEN seq % 7 = 6 THEN 'duration=' || CAST(value AS STRING) || 's' ELSE '' END""",
    },
    # camera messages of all classes, some with bad topics or broken bodies
    "camera": {
        "seq": "seq",
        "ts": "ts",
        "topic": """
            CASE seq % 8 WHEN 0 THEN 'surveillance/' || event_type || '/camera/cam_' || CAST(user_id AS
            STRING) || '/status' WHEN 1 THEN 'surveillance/' || event_type || '/camera/cam_' || CAST(user_id
            AS STRING) || '/motion' WHEN 2 THEN 'surveillance/' || event_type || '/camera/cam_' ||
            CAST(user_id AS STRING) || '/stream' WHEN 3 THEN 'security/' || event_type || '/camera/cam_' ||
            CAST(user_id AS STRING) || '/event' WHEN 4 THEN 'system/' || event_type || '/camera/cam_' ||
            CAST(user_id AS STRING) || '/event' WHEN 5 THEN 'a/b' WHEN 6 THEN 'other/' || event_type ||
            '/camera/cam_' || CAST(user_id AS STRING) || '/event' ELSE 'security/' || event_type ||
            '/camera/cam_' || CAST(user_id AS STRING) || '/motion' END""",
        "payload": """
            CASE WHEN seq % 19 = 0 THEN '{{"broken": ' WHEN seq % 23 = 0 THEN '{{}}' ELSE '{{"device_type":
            "Camera", "status": "' || event_type || '", "temperature": ' || CAST(value AS STRING) || ',
            "cpu_usage": 12.5, "recording": true, "confidence": ' || CAST(value AS STRING) || ',
            "motion_area_percent": 7.5, "event_type": "' || event_type || '", "requires_attention": true,
            "current_fps": ' || CAST(user_id % 30 AS STRING) || ', "bitrate_kbps": 4000, "quality_score":
            0.9, "bounding_boxes": [{{"x": 1, "y": 2, "width": 3, ' || '"height": 4, "confidence": 0.5}}]}}'
            END""",
    },
}

PARENTS = {name: ("events" if name == "traffic" else "traffic") for name in VIEWS}


def view_columns(name: str, dialect: str) -> dict[str, str]:
    return {alias: text.format(**DIALECTS[dialect]) for alias, text in VIEWS[name].items()}


def view_sql(name: str) -> str:
    """A view for the checking engine."""
    columns = ", ".join(f'{text} AS "{alias}"' for alias, text in view_columns(name, "oracle").items())
    return f"SELECT {columns} FROM {PARENTS[name]}"


def oracle(body: str, *views: str) -> str:
    """An oracle query over the named views; ``body`` may start with further common table expressions."""
    names = [name for name in VIEWS if name in views or (views and name == "traffic")]
    if not names:
        return body
    prefix = ",\n".join(f"{name} AS ({view_sql(name)})" for name in names)
    body = body.strip()
    return f"WITH {prefix},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {prefix}\n{body}"


class Tables:
    """The supplied tables and the views over them as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, events: DataFrame | None = None) -> DataFrame:
        """A view by name; ``events`` replaces the events table, by a stream of it for instance."""
        if name not in VIEWS:
            return self.table(name) if events is None else events
        columns = view_columns(name, "spark")
        return self.view(PARENTS[name], events).select(*[F.expr(text).alias(alias) for alias, text in columns.items()])

    @property
    def traffic(self) -> DataFrame:
        return self.view("traffic")

    @property
    def messages(self) -> DataFrame:
        """Traffic as received messages with byte payloads."""
        return as_messages(self.traffic)


def as_messages(traffic: DataFrame) -> DataFrame:
    return traffic.select(
        "seq", F.coalesce("topic", F.lit("lost")).alias("topic"), F.encode("payload", "UTF-8").alias("payload"),
        "qos", (F.col("retain") == 1).alias("retain"), F.coalesce("ts", F.timestamp_seconds(F.lit(0))).alias("ts"))
