"""Streams give what the batch gives; rows beyond the watermark are dropped."""

import random
import time

import pytest
from helpers import at, in_order, random_features
from pyspark.sql import functions as F

from telemill.operators import detection, logs, messages, windows
from telemill.operators.detection import Rules
from telemill.schemas import MESSAGE_SCHEMA
from telemill.sources.messages import message_stream
from telemill.streaming import collect, detect, handshakes, sinks

FEATURES = "seq BIGINT, ts TIMESTAMP, client_id STRING, topic STRING, payload_length BIGINT, qos INT, retain_flag INT"
CONNECTIONS = "client_id STRING, ts TIMESTAMP, packet_type STRING, src_ip STRING"
RULES = Rules().override(flood_detection={"threshold": 2}, topic_enumeration={"threshold": 2},
                         qos_abuse={"threshold": 1, "window_seconds": 60}, retain_abuse={"threshold": 1, "window_seconds": 60},
                         reconnect_storm={"threshold": 2})


@pytest.fixture
def arrivals(spark, tmp_path):
    """Writes one file per call and opens the stream over all of them."""
    folder = str(tmp_path / "arrivals")

    class Arrivals:
        def add(self, rows, schema):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

        def stream(self, schema):
            return message_stream(spark, folder, schema=schema, files_per_trigger=1)

        def batch(self):
            return spark.read.parquet(folder)

        def run(self, stream, name="out"):
            path = str(tmp_path / name)
            sinks.run_to_end(stream, path, str(tmp_path / f"{name}-checkpoint"))
            return spark.read.schema(stream.schema).parquet(path)

    return Arrivals()


def same(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def feature(seq, seconds, client, topic="t", size=3, qos=2, retain=1):
    return (seq, at(seconds), client, topic, size, qos, retain)


def test_traffic_log(spark, tmp_path, arrivals):
    rows = [(f"a/{i}/x", bytearray(b'{"device_id":"d"}'), 1, True, at(i)) for i in range(5)]
    arrivals.add(rows[:3], MESSAGE_SCHEMA)
    arrivals.add(rows[3:] + [("$SYS/x", bytearray(b""), 0, False, at(9))], MESSAGE_SCHEMA)
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")

    def collected():
        collect.append_traffic_log(arrivals.stream(MESSAGE_SCHEMA), path, checkpoint, filters=["#"],
                                   available_now=True).awaitTermination()
        return spark.read.parquet(path)

    batch = messages.collect_messages(arrivals.batch().where("topic not like '$%'"), keep=())
    assert same(collected(), batch)
    assert len(batch.columns) == 17
    arrivals.add([("late/one/x", bytearray(b""), 0, False, at(60))], MESSAGE_SCHEMA)
    assert collected().count() == 6  # restarting picks up only what is new


def test_interval_stats(arrivals):
    rows = [("t", bytearray(b""), 0, False, at(s)) for s in (0, 3, 12, 100)]
    arrivals.add(rows, MESSAGE_SCHEMA)
    got = arrivals.run(collect.stats_stream(arrivals.stream(MESSAGE_SCHEMA), "5 seconds"))
    assert sorted(r.messages for r in got.collect()) == [1, 2]


def test_row_alerts(arrivals):
    arrivals.add([feature(0, 0, "a", "#"), feature(1, 1, "a", "$SYS/x"), feature(2, 2, None, None, 0)], FEATURES)
    arrivals.add([feature(3, 3, "b", "t", 20000)], FEATURES)
    got = arrivals.run(detect.row_alerts(arrivals.stream(FEATURES)))
    assert same(got, detection.detect_stateless(arrivals.batch())) and got.count() == 3


def test_window_alerts(arrivals):
    rows = [feature(i, s, "a", f"t{i}") for i, s in enumerate((0, 10, 59, 61, 62))]
    arrivals.add(rows, FEATURES)
    arrivals.add([feature(10 + i, 120 + i, "b", f"t{i}") for i in range(4)], FEATURES)
    arrivals.add([feature(99, 5000, "z")], FEATURES)  # moves the watermark past all other windows
    got = arrivals.run(detect.window_alerts(arrivals.stream(FEATURES), RULES, "1 minute"))
    assert same(got, windows.detect_windowed(arrivals.batch(), RULES)) and got.count() > 4


def test_late_rows_are_dropped(arrivals):
    arrivals.add([feature(i, i, "a") for i in range(3)] + [feature(5, 1000, "a")], FEATURES)
    arrivals.add([feature(6, 1100, "a")], FEATURES)
    arrivals.add([feature(7, 5, "a"), feature(8, 9000, "a")], FEATURES)
    got = arrivals.run(detect.window_alerts(arrivals.stream(FEATURES), RULES, "1 minute"))
    flood = got.where(F.col("rule_name") == RULES["flood_detection"].name).collect()
    assert [r.observed for r in flood] == [3]


def test_connection_alerts(arrivals):
    rows = [("a", at(i), "CONNECT", "1") for i in range(3)] + [("b", at(1), "PUBLISH", "1"), ("b", at(2), "PUBLISH", "2")]
    arrivals.add(rows, CONNECTIONS)
    arrivals.add([("z", at(9000), "CONNECT", "9")], CONNECTIONS)
    got = arrivals.run(detect.connection_alerts(arrivals.stream(CONNECTIONS), RULES))
    batch = windows.reconnect_storm(arrivals.batch(), RULES).unionByName(windows.duplicate_client(arrivals.batch(), RULES))
    assert same(got, batch) and got.count() == 2


def test_cumulative_rules_across_batches_and_restarts(arrivals):
    rows = [(seq, at(seconds), *rest) for seq, (seconds, *rest) in in_order(random_features(11, 500))]
    checks = ["flood_detection", "topic_enumeration", "qos_abuse", "retain_abuse"]
    raised = []
    for part in (rows[:150], rows[150:180], rows[180:400], rows[400:]):
        arrivals.add(part, FEATURES)
        found = arrivals.run(detect.cumulative_alerts(arrivals.stream(FEATURES), RULES, keep=("seq",)))  # goes on from its checkpoint
        raised.append(found.count())
    assert raised == sorted(set(raised))
    assert same(found, detection.detect(arrivals.batch(), RULES, checks, keep=("seq",)))


def test_cumulative_counts_of_odd_rows(arrivals):
    rows = [feature(1, 0, None, None, qos=None, retain=None), feature(2, None, None, None), feature(3, None, "", "")]
    arrivals.add(rows, FEATURES)
    rules = Rules().override(flood_detection={"threshold": 0}, topic_enumeration={"threshold": 0},
                             qos_abuse={"threshold": 0}, retain_abuse={"threshold": 0})
    found = arrivals.run(detect.cumulative_alerts(arrivals.stream(FEATURES), rules, keep=("seq",)))
    assert same(found, detection.detect(arrivals.batch(), rules, list(detection.COUNTED), keep=("seq",)))
    assert found.count() == 8


def test_idle_clients_are_forgotten(spark, arrivals, tmp_path):
    arrivals.add([feature(1, 0, "a"), feature(2, 1, "a")], FEATURES)
    rules, path = Rules().override(flood_detection={"threshold": 1}), str(tmp_path / "out")
    alerts = detect.cumulative_alerts(arrivals.stream(FEATURES), rules, ["flood_detection"], idle="1 second", keep=("seq",))
    query = sinks.append_to_table(alerts, path, str(tmp_path / "checkpoint"), every="1 second")

    def until_read(n):  # such a query never has nothing to do, so it is watched
        for _ in range(300):
            if sum(p["numInputRows"] for p in query.recentProgress) >= n:
                return
            time.sleep(0.2)
        raise AssertionError(query.exception() or "not read in time")

    try:
        for n, rows in ((2, [feature(3, 2, "a")]), (3, [feature(4, 3, "a")])):
            until_read(n)
            time.sleep(3)  # longer than counts are remembered
            arrivals.add(rows, FEATURES)
        until_read(4)
    finally:
        query.stop()
    assert [r.seq for r in spark.read.schema(alerts.schema).parquet(path).collect()] == [2]


def test_handshakes_across_batches_and_restarts(arrivals):
    schema = "seq BIGINT, ts TIMESTAMP, client_id STRING, message_id BIGINT, action STRING, handshake_step STRING"
    rng = random.Random(4)
    rows = [(i, at(i // 2) if i < 115 else None, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), "publish",
             rng.choice(["PUBLISH", "PUBCOMP", "PUBREC"])) for i in range(120)]
    rng.shuffle(middle := rows[40:70])
    for part in (rows[:40], middle, rows[70:]):
        arrivals.add(part, schema)
        found = arrivals.run(handshakes.qos2_pairing_stream(arrivals.stream(schema)))
    assert same(found, logs.qos2_pairing(arrivals.batch()))
