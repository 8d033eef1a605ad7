"""Detection against a sequential loop and the worked cases."""

from collections import Counter

import pytest
from helpers import at, feature_rows, in_order, random_features

from telemill.operators import detection
from telemill.operators.detection import Rules
from telemill.sources import tables

RULES = Rules().override(flood_detection={"threshold": 40}, topic_enumeration={"threshold": 8},
                         qos_abuse={"threshold": 15}, retain_abuse={"threshold": 25})


def sequential(rows, rules):
    """(seq, rule, description) by one pass in order with a dictionary per client."""
    state, found = {}, []
    limit = {key: rules[key].threshold for key in rules.table}
    for seq, (_, client, topic, size, qos, retain) in in_order(rows):
        own = state.setdefault(client, {"n": 0, "topics": set(), "qos2": 0, "retained": 0})
        own["n"] += 1
        own["topics"].add(topic)
        own["qos2"] += qos == 2

        def alert(key, text):
            found.append((seq, rules[key].name, text))

        if own["n"] > limit["flood_detection"]:
            alert("flood_detection", f"Client exceeded {limit['flood_detection']} messages")
        if len(own["topics"]) > limit["topic_enumeration"]:
            alert("topic_enumeration", f"Client accessed {len(own['topics'])} unique topics")
        if topic is None:
            continue
        hit = [p for p in rules["wildcard_abuse"].patterns if p in topic]
        if hit:
            alert("wildcard_abuse", f"Wildcard pattern detected: {hit[0]}")
        if size is not None and not 1 <= size <= 10000:
            alert("payload_anomaly", f"Anomalous payload size: {size} bytes")
        if own["qos2"] > limit["qos_abuse"]:
            alert("qos_abuse", f"Excessive QoS 2 usage: {own['qos2']} messages")
        hit = [p for p in rules["system_topic_access"].patterns if topic.startswith(p)]
        if hit:
            alert("system_topic_access", f"Access to system topic: {hit[0]}")
        if retain:
            own["retained"] += 1
            if own["retained"] > limit["retain_abuse"]:
                alert("retain_abuse", f"Excessive retain messages: {own['retained']}")
    return found


def alerts(df, rules, **options):
    return [(r.seq, r.rule_name, r.description) for r in detection.detect(df, rules, keep=("seq",), **options).collect()]


@pytest.mark.parametrize("seed, options", [(3, {}), (4, {"max_rows": 11}), (5, {"max_rows": 9})])
def test_equals_sequential_loop(spark, seed, options):
    rows = random_features(seed, 600)
    df = feature_rows(spark, rows).repartition(6)
    assert Counter(alerts(df, RULES, **options)) == Counter(sequential(rows, RULES))


def row(n, topic="t", size=5, qos=0, retain=0):
    return (float(n), "c", topic, size, qos, retain)


def by_rule(spark, rows):
    return Counter(r for _, r, _ in alerts(feature_rows(spark, rows), Rules()))


def test_flood(spark):
    assert by_rule(spark, [row(i) for i in range(105)]) == {"Message Flood Attack": 5}


def test_topic_enumeration_counts(spark):
    rows = [row(i, f"t{i}") for i in range(22)] + [row(30, "t0")]
    texts = [d for _, r, d in sorted(alerts(feature_rows(spark, rows), Rules()))]
    assert texts == [f"Client accessed {n} unique topics" for n in (21, 22, 22)]


def test_wildcard_and_system_topic(spark):
    assert by_rule(spark, [row(0, "$SYS/#")]) == {
        "Wildcard Subscription Abuse": 1, "Unauthorized System Topic Access": 1}


def test_payload_sizes(spark):
    rows = [row(i, size=s) for i, s in enumerate([0, 1, 10000, 10001, None])]
    assert by_rule(spark, rows) == {"Payload Anomaly Attack": 2}


def test_qos_abuse_reports_any_later_row(spark):
    rows = [row(i, qos=2) for i in range(51)] + [row(60, qos=0)]
    assert by_rule(spark, rows) == {"QoS Level Abuse": 2}


def test_retain_rule_fires(spark):
    assert by_rule(spark, [row(i, retain=1) for i in range(102)]) == {
        "Message Flood Attack": 2, "Retain Message Abuse": 2}


def test_missing_columns(spark):
    df = spark.createDataFrame([(0, at(0), "c")], "seq BIGINT, ts TIMESTAMP, client_id STRING")
    assert [r for _, r, _ in alerts(df, Rules())] == ["Payload Anomaly Attack"]


def test_once_per_client(spark):
    rows = random_features(9, 400)
    df = feature_rows(spark, rows)
    first = {}
    for seq, rule, text in sequential(rows, RULES):
        first.setdefault((rows[seq][1], rule), (seq, text))
    got = detection.detect(df, RULES, once_per_client=True, keep=("seq",)).collect()
    assert {(r.client_id, r.rule_name): (r.seq, r.description) for r in got} == first


def test_checks_subset(spark):
    df = feature_rows(spark, random_features(3, 300))
    everything = [a for a in alerts(df, RULES) if a[1] == RULES["qos_abuse"].name]
    assert Counter(alerts(df, RULES, checks=["qos_abuse"])) == Counter(everything)


def test_blocked_and_severity(spark):
    made = detection.detect(feature_rows(spark, [row(0, "$SYS/a")]), Rules())
    first = made.first()
    assert (first.severity, first.action, first.blocked, first.timestamp) == ("HIGH", "BLOCK", True, "2024-01-01T00:00:00.000000")
    assert detection.high_severity(made).count() == 1


def test_client_stats(spark):
    df = feature_rows(spark, [row(0, "a", 2, 2), row(1, None, 4), row(5, "a", None, 2), row(7, None, 6)])
    stats = detection.client_stats(df).first()
    assert (stats.message_count, stats.topic_count, stats.qos2_count) == (4, 2, 2)
    assert (stats.min_payload_length, stats.max_payload_length, stats.avg_payload_length) == (2, 6, 4.0)


def test_alert_summary(spark):
    df = feature_rows(spark, [row(i) for i in range(103)] + [row(200, "#")])
    made = detection.detect(df, Rules())
    summary = {(r.dimension, r.name): r.alerts for r in detection.alert_summary(made, None, df).collect()}
    assert summary == {("severity", "HIGH"): 4, ("severity", "MEDIUM"): 1, ("action", "BLOCK"): 4, ("action", "ALERT"): 1,
                       ("clients", "analyzed"): 1}
    latest = {(r.dimension, r.name): r.alerts for r in detection.alert_summary(made, 2).collect()}
    assert latest == {("severity", "HIGH"): 1, ("severity", "MEDIUM"): 1, ("action", "BLOCK"): 1, ("action", "ALERT"): 1}


def test_rule_table(spark):
    table = Rules().frame(spark)
    assert table.count() == 9
    assert table.where("rule = 'qos_abuse'").first().window_seconds == 3600


def test_alert_file_quotes_and_appends(spark, tmp_path):
    made = detection.detect(feature_rows(spark, [row(0, 'a,"#"')]), Rules())
    path = str(tmp_path / "alerts")
    assert tables.write_alerts(made, path) == 1 and tables.write_alerts(made, path) == 1
    back = tables.read_alerts(spark, path)
    assert back.count() == 2 and back.exceptAll(made.unionAll(made)).count() == 0


def test_detection_has_no_pairwise_plan(spark):
    df = feature_rows(spark, random_features(1, 50))
    plan = detection.detect(df, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
