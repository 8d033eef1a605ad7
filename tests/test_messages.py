"""Messages, subscriptions, devices, cameras and the report."""

import random

import pytest
from helpers import at, one
from pyspark.sql import functions as F
from test_fields import python_match

from telemill.functions import topics
from telemill.operators import camera, devices, messages, report, subscriptions
from telemill.operators.ordered import Order

MESSAGE = "topic STRING, payload BINARY, qos INT, retain BOOLEAN, ts TIMESTAMP"


def received(spark, *rows):
    return spark.createDataFrame([(t, bytearray(p), q, r, at(s)) for t, p, q, r, s in rows], MESSAGE)


def test_collect_messages(spark):
    df = received(spark, ("site/x/temp/device_001/telemetry", b'{"device_id":"d1","v":"\xff\xc3\xa9"}', 2, True, 1),
                  ("a/b", b"x" * 300, 0, None, 2.5))
    first, second = messages.collect_messages(df, "h", 99).orderBy("timestamp").collect()
    assert (first.timestamp, first.client_id, first.device_type) == ("2024-01-01T00:00:01.000000+00:00", "d1", "temp")
    assert (first.qos, first.retain, first.dst_ip, first.dst_port, first.payload_length) == (2, 1, "h", "99", 26)
    assert first.payload_sample == '{"device_id":"d1","v":"é"}'
    assert (second.client_id, second.device_type, second.retain, second.msgid) == ("unknown", "unknown", 0, None)
    assert (second.payload_length, len(second.payload_sample)) == (300, 200)


def test_collection_stats(spark):
    df = received(spark, *[("t", b"", 0, False, s) for s in (0, 4, 9.5, 20)])
    assert one(messages.collection_stats(df)) == {"messages": 4, "runtime_sec": 20.0, "messages_per_sec": 0.2}
    assert sorted(r.messages for r in messages.interval_stats(df).collect()) == [1, 3]
    assert one(messages.collection_stats(df.limit(0)))["messages_per_sec"] == 0.0


def test_match_subscriptions(spark):
    rng = random.Random(5)
    names = ["/".join(rng.choice(["a", "b", "c", "$SYS", ""]) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    filters = sorted({"/".join(rng.choice(["a", "b", "+", "$SYS"]) for _ in range(rng.randint(1, 4)))
                      + rng.choice(["", "/#"]) for _ in range(60)} | {"#", "+"})
    df = spark.createDataFrame(list(enumerate(names)), "i INT, topic STRING")
    table = subscriptions.filter_table(spark, filters)
    expected = {(i, f) for i, name in enumerate(names) for f in filters if python_match(name, f)}
    got = [(r.i, r.filter) for r in subscriptions.match_subscriptions(df, table).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_many_shapes_and_odd_levels(spark):
    rng = random.Random(8)
    level = ["a", "b", "a+b", "x\n", ""]
    names = ["/".join(rng.choice(level) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a\nb", "a/b\n", "a+b/c"]
    filters = sorted({"/".join(rng.choice(["+", "+", rng.choice(level)]) for _ in range(rng.randint(1, 9)))
                      + rng.choice(["", "/#"]) for _ in range(1500)} | {"#", "a/b", "a+b/c"})
    shapes = {"/".join(p if p in "+#" and p else "x" for p in f.split("/")) for f in filters}
    assert len(shapes) > 500
    df = spark.createDataFrame(list(enumerate(names)), "i INT, topic STRING")
    expected = {(i, f) for i, name in enumerate(names) for f in filters if python_match(name, f)}
    got = [(r.i, r.filter) for r in
           subscriptions.match_subscriptions(df, subscriptions.filter_table(spark, filters)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("wide", [1, 64])
def test_many_filters_go_down_in_lists(spark, monkeypatch, wide):
    """Beginnings of topics walk with lists of nodes: a row per message, not one per message and filter."""
    monkeypatch.setattr(subscriptions, "SMALL", 10)
    monkeypatch.setattr(subscriptions, "WIDE", wide)
    rng = random.Random(11)
    level = ["a", "b", "", "$SYS", "x+y"]
    names = ["/".join(rng.choice([*level, "+", "#"]) for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["a", "a", None, "z/z"]
    filters = sorted({"/".join(rng.choice(["+", "+", *level]) for _ in range(rng.randint(1, 4)))
                      + rng.choice(["", "/#"]) for _ in range(150)} | {"+", "a"})
    df = spark.createDataFrame(list(enumerate(names)), "i INT, topic STRING")
    table = subscriptions.filter_table(spark, [*filters, "a/b"]).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    filters = sorted({*filters, "a/b"})
    expected = sorted((i, f) for i, name in enumerate(names) if name is not None for f in filters if python_match(name, f))
    assert sorted((r.i, r.filter) for r in subscriptions.match_subscriptions(df, table).collect()) == expected
    listed = subscriptions.match_subscriptions(df, table, listed=True)
    assert listed.columns == ["i", "topic", "filters"]
    rows = listed.collect()
    assert len(rows) == len({i for i, _ in expected}) and sorted((r.i, f) for r in rows for f in r.filters) == expected
    assert subscriptions.match_subscriptions(df, table.limit(0), listed=True).count() == 0
    assert [r.filters for r in subscriptions.match_subscriptions(
        df.where("i < 9 AND topic NOT LIKE '$%'"), subscriptions.filter_table(spark, ["#"]), listed=True).collect()] == [["#"]] * sum(
        not n.startswith("$") for n in names[:9])


def test_topic_filter_and_line_breaks(spark):
    df = spark.createDataFrame([("a/b\n",), ("a\nb",), ("a/b",)], "topic STRING")
    hits = lambda f: [r.m for r in df.select(topics.topic_matches(F.col("topic"), f).alias("m")).collect()]
    assert hits("a/b") == [False, False, True]
    assert hits("#") == [True, True, True]


def test_matching_has_no_pairwise_plan(spark):
    df = spark.createDataFrame([("a/b",)], "topic STRING")
    joined = subscriptions.match_subscriptions(df, subscriptions.filter_table(spark, ["a/+", "#"]))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_subscribed(spark):
    df = spark.createDataFrame([("a/b",), ("c",), (None,)], "topic STRING")
    assert [r.topic for r in subscriptions.subscribed(df, ["a/#", "a/+"]).collect()] == ["a/b"]


ROWS = [("vibration/cooler-iotsim-cooler-motor-1", ""), ("hydraulic/rig-1", None), (None, "PHLV=3"), ("x", "nothing")]


def test_classify_devices(spark):
    df = spark.createDataFrame(ROWS, "topic STRING, Payload_sample STRING")
    found = {(r.topic, r.device_type) for r in devices.classify_devices(df).collect()}
    assert found == {(ROWS[0][0], "Vibration"), (ROWS[0][0], "CoolerMotor"), (ROWS[1][0], "HydraulicSystem"),
                     (None, "PhLevelSensor")}
    counts = {r.device_type: r.records for r in devices.device_counts(devices.classify_devices(df)).collect()}
    assert len(counts) == 19 and counts["Vibration"] == 1 and counts["Door"] == 0


def test_sample_per_device(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 20, "Fan").otherwise("Door").alias("device_type"))
    drawn = devices.sample_per_device(df, "id", n=100, seed=1)
    assert {r.device_type: r["count"] for r in drawn.groupBy("device_type").count().collect()} == {"Fan": 20, "Door": 100}
    again = devices.sample_per_device(df.repartition(9), "id", n=100, seed=1)
    assert {r.id for r in drawn.collect()} == {r.id for r in again.collect()}
    other = devices.sample_per_device(df, "id", n=100, seed=2)
    assert {r.id for r in drawn.collect()} != {r.id for r in other.collect()}
    mean = drawn.where("device_type = 'Door'").agg(F.avg("id")).first()[0]
    assert 1900 < mean < 3100


def test_replay_records(spark):
    df = spark.createDataFrame([(i, at(i), "Door Lock", "{}", "Door") for i in range(7)],
                               "seq BIGINT, ts TIMESTAMP, topic STRING, Payload_sample STRING, device_type STRING")
    rows = devices.replay_records(df, F.lit("T"), Order(("device_type",))).orderBy("seq").collect()
    assert rows[6].topic == "site/canonical/door/device_002/telemetry"
    assert [r.topic[-14:-10] for r in rows[:5]] == ["_001", "_002", "_003", "_004", "_005"]
    assert '"canonical_record_id":6' in rows[6].payload


CAMERA = [
    ("surveillance/lobby/camera/cam_001/motion", '{"confidence":0.5,"bounding_boxes":[{"x":1,"confidence":0.9}]}'),
    ("security/lobby/camera/cam_002/event", '{"event_type":"face","severity":"warning","details":{"n":3}}'),
    ("system/lobby/camera/cam_002/event", '{"event_type":null,"requires_attention":true}'),
    ("surveillance/lobby/camera/cam_001/stream", '{"current_fps":25}'),
    ("surveillance/lobby/camera/cam_001/status", "{}"),
    ("other/lobby/camera/cam_001/event", "{}"),
    ("a/b", "{}"),
    ("surveillance/lobby/camera/cam_001/status", "{broken"),
    ("surveillance/lobby/camera/cam_001/status", None),
]


def test_camera(spark):
    df = spark.createDataFrame(CAMERA, "topic STRING, payload STRING")
    counts = {r.camera_class: r.messages for r in camera.camera_stats(df).collect()}
    assert counts == {"status": 1, "motion": 1, "stream": 1, "security": 1, "system": 1, "total": 6}
    parsed = camera.parse_camera_topic(df).where("message_type = 'motion'").first()
    assert (parsed.zone, parsed.camera_id) == ("lobby", "cam_001")
    assert one(camera.camera_motion(df)) == {
        "zone": "lobby", "camera_id": "cam_001", "confidence": 0.5, "motion_area_percent": 0.0, "alert_level": "unknown"}
    assert one(camera.camera_status(df)) == {
        "zone": "lobby", "camera_id": "cam_001", "status": "unknown", "temperature": 0.0, "cpu_usage": 0.0, "recording": False}
    assert one(camera.camera_security(df))["severity"] == "warning"
    assert one(camera.camera_system(df))["event_type"] == "unknown"
    assert one(camera.camera_stream(df))["current_fps"] == 25
    assert camera.camera_messages(df, "motion").first().message.bounding_boxes[0].confidence == 0.9
    assert camera.camera_messages(df, "security").first().message.details == {"n": "3"}


def test_security_topic_with_motion_is_motion(spark):
    df = spark.createDataFrame([("security/z/camera/c/motion", "{}")], "topic STRING, payload STRING")
    assert camera.route_camera(df).first().camera_class == "motion"


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_report(spark, tmp_path, file_format):
    present = str(tmp_path / "there")
    spark.range(3).write.format(file_format).option("header", True).save(present)
    rows = report.pipeline_report(
        spark, {"Canonical Dataset": present, "Security Alerts": str(tmp_path / "gone")}, file_format).collect()
    assert [tuple(r) for r in rows] == [("Canonical Dataset", "OK", 3), ("Security Alerts", "MISSING", None)]
