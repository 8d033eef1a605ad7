"""Attack log statistics on worked cases."""

import pytest
from helpers import at, one

from telemill.operators import logs
from telemill.schemas import ATTACK_LOG_SCHEMAS
from telemill.sources import tables


def log(spark, names, rows):
    return spark.createDataFrame(rows, names)


def test_reconnect_stats(spark):
    rows = [("connect", "success")] * 8 + [("bomb_connect", "failed")] * 2 + [
        ("connect", "exception"), ("bomb_connect", "exception"), ("disconnect", "voluntary"), ("bomb_disconnect", "voluntary")]
    stats = one(logs.reconnect_stats(log(spark, "action STRING, status STRING", rows)))
    assert stats == {"connections": 10, "disconnections": 2, "failures": 3, "active": 6, "success_percent": 70.0}
    assert one(logs.reconnect_stats(log(spark, "action STRING, status STRING", [("x", "y")])))["success_percent"] is None


QOS2 = "seq BIGINT, ts TIMESTAMP, client_id STRING, message_id BIGINT, action STRING, handshake_step STRING, " \
       "status STRING, details STRING"


@pytest.mark.parametrize("options", [{}, {"max_rows": 1}])
def test_qos2_pairing(spark, options):
    rows = [
        (0, at(0), "c", 1, "publish", "PUBLISH", "sent", ""), (1, at(1.5), "c", 1, "qos2_handshake", "PUBCOMP", "", ""),
        (2, at(2), "c", 1, "qos2_handshake", "PUBCOMP", "", ""),
        (3, at(3), "c", 2, "publish", "PUBLISH", "sent", ""), (4, at(4), "c", 2, "publish", "PUBLISH", "sent", ""),
        (5, at(9), "d", 2, "qos2_handshake", "PUBCOMP", "", ""), (6, at(10), "c", 2, "qos2_handshake", "PUBCOMP", "", ""),
    ]
    got = {r.seq: (r.handshake_sec, r.unexpected) for r in logs.qos2_pairing(log(spark, QOS2, rows), **options).collect()}
    assert got == {1: (1.5, False), 2: (None, True), 5: (None, True), 6: (6.0, False)}


def test_qos2_stats(spark):
    rows = [
        (0, at(0), "c", 1, "publish", "PUBLISH", "sent", ""), (1, at(0), "c", 2, "publish", "PUBLISH", "sent", ""),
        (2, at(0), "c", 1, "qos2_handshake", "PUBREC", "", ""), (3, at(0), "c", 1, "qos2_handshake", "PUBCOMP", "", ""),
        (4, at(0), "c", 0, "publish", "", "exception", ""), (5, at(0), "c", 0, "publish", "", "failed", ""),
        (6, at(0), "c", 0, "message_received", "", "received", ""), (7, at(0), "c", 0, "mixed_handshake", "", "", "duration=0.250s"),
        (8, at(0), "c", 0, "mixed_handshake", "", "", "duration=0.750s"),
    ]
    assert one(logs.qos2_stats(log(spark, QOS2, rows))) == {
        "published": 2, "received": 1, "pubrec": 1, "pubcomp": 1, "failures": 2, "mixed_handshake_sec": 0.5,
        "completion_percent": 50.0}


def test_enumeration(spark):
    rows = [("subscribe_attempt", "subscribed", "a"), ("subscribe_attempt", "failed", "b"), ("subscribe_attempt", "error", "c"),
            ("wildcard_subscribe", "subscribed", "#"), ("message_received", "success", "z"),
            ("wildcard_message", "discovered", "y"), ("wildcard_message", "discovered", "z")]
    df = log(spark, "action STRING, status STRING, topic STRING", rows)
    assert one(logs.enumeration_stats(df)) == {
        "subscription_attempts": 3, "successful_subscriptions": 1, "received_messages": 3, "discovered_topics": 2}
    assert [r.topic for r in logs.discovered_topics(df).collect()] == ["y", "z"]


def test_duplicate_id(spark):
    rows = [("connect_attempt", "connected", "True", "True"), ("connect_attempt", "failed", "False", "False"),
            ("connect_attempt", "exception", "False", "False"), ("disconnect", "involuntary", "False", "True"),
            ("takeover_attempt", "connected", "True", "True")]
    df = log(spark, "action STRING, status STRING, session_present STRING, conflict_detected STRING", rows)
    assert one(logs.duplicate_id_stats(df)) == {
        "connection_attempts": 2, "successful_connections": 1, "disconnections": 1, "counted_conflicts": 1,
        "flagged_conflicts": 3}


def test_bruteforce(spark):
    rows = [("SUBACK", "granted", 10.0), ("SUBACK", "denied", 30.0), ("CONNECT", "success", None),
            ("CONNECT", "failed", None), ("message", "received", None)]
    stats = one(logs.bruteforce_stats(log(spark, "packet_type STRING, status STRING, latency_ms DOUBLE", rows)))
    assert (stats["granted"], stats["denied"], stats["connected"], stats["refused"]) == (1, 1, 1, 1)
    assert (stats["avg_latency_ms"], stats["p95_latency_ms"], stats["max_latency_ms"]) == (20.0, 30.0, 30.0)


def test_retain_qos(spark):
    rows = [(at(1), "retain_flood", "sent", "a"), (at(2), "retain_flood", "failed", "b"), (at(3), "qos2_abuse", "failed", "c"),
            (at(12), "mixed_qos_retain", "sent", "d"), (at(13), "mixed_qos_retain", "error", "d"),
            (at(14), "retain_create", "sent", "e")]
    df = log(spark, "ts TIMESTAMP, attack_type STRING, status STRING, topic STRING", rows)
    assert one(logs.retain_qos_stats(df)) == {"sent": 3, "retained_topics": 1}
    assert sorted((r.sent, r.messages_per_sec) for r in logs.retain_qos_rate(df).collect()) == [(1, 0.1), (2, 0.2)]


def test_payload_anomaly(spark):
    df = log(spark, "anomaly_type STRING, status STRING", [
        ("null_bytes", "sent"), ("null_bytes", "error"), ("null_bytes", "sent"), ("odd", "failed")])
    got = {r.anomaly_type: (r.sent, r.failed, r.error) for r in logs.payload_anomaly_stats(df).collect()}
    assert got == {"null_bytes": (2, 0, 1), "other": (0, 1, 0), "all": (2, 1, 1)}


def test_required_fields(spark):
    full = log(spark, ATTACK_LOG_SCHEMAS["flood"], [("1", "c", "ip", None, "PUBLISH", 1, 0, 1, 0)])
    row = one(logs.check_required_fields(full, "Publish FLOOD"))
    assert row["compliant"] and row["missing"] == [] and {f.field: f.filled for f in row["filled"]}["topic"] == 0
    assert one(logs.check_required_fields(full.drop("src_ip", "qos"), "flood"))["missing"] == ["src_ip", "qos"]
    assert not one(logs.check_required_fields(full.limit(0), "flood"))["compliant"]
    assert one(logs.check_required_fields(full.select("mid"), "reconnect"))["compliant"]
    utc = full.withColumnRenamed("timestamp", "timestamp_utc")
    assert one(logs.check_required_fields(utc, "flood"))["compliant"]


def test_compliance_summary(spark):
    full = log(spark, ATTACK_LOG_SCHEMAS["flood"], [("1", "c", "ip", "t", "PUBLISH", 1, 0, 1, 0)])
    got = {r.attack: (r.entries, r.compliant_logs, r.logs)
           for r in logs.compliance_summary({"flood": full, "brute": full, "other": full}).collect()}
    assert got == {"flood": (1, 1, 1), "brute": (1, 0, 1), "other": (1, 1, 1), "overall": (3, 2, 3)}


@pytest.mark.parametrize("kind", sorted(ATTACK_LOG_SCHEMAS))
def test_read_attack_log(spark, tmp_path, kind):
    empty = spark.createDataFrame([], ATTACK_LOG_SCHEMAS[kind])
    header = ",".join(empty.columns)
    values = ["2024-01-01T00:00:00+00:00" if c.startswith("timestamp") else "1" for c in empty.columns]
    path = tmp_path / f"{kind}.csv"
    path.write_text(f"{header}\n{','.join(values)}\n")
    df = tables.read_attack_log(spark, str(path), kind)
    assert df.columns == [*empty.columns, "ts"]
    row = df.first()
    assert row.ts.isoformat() == "2024-01-01T00:00:00" and all(v is not None for v in row)


def test_unknown_log(spark):
    with pytest.raises(ValueError):
        tables.read_attack_log(spark, "x", "other")
