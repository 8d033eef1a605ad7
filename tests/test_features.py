import pytest
from helpers import at, one
from pyspark.sql import functions as F

from telemill.operators import features
from telemill.operators.ordered import Order
from telemill.sources import tables


def test_inter_arrival(spark):
    rows = [(0, at(0), "a"), (1, at(10), "a"), (2, at(5), "b"), (3, at(25), "a"), (4, None, "a")]
    df = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP, client_id STRING")
    got = {r.seq: r.iat_sec for r in features.inter_arrival(df, Order(("client_id",))).collect()}
    assert got == {0: 0.0, 1: 10.0, 2: 0.0, 3: 15.0, 4: 0.0}


LOG = "timestamp STRING, clientid STRING, src_ip STRING, topic STRING, payload_sample STRING, payload_length STRING, " \
      "qos STRING, retain STRING, dupflag STRING, msgid STRING, label STRING"


def test_extract_features(spark):
    df = spark.createDataFrame([
        ("1700000000.25", "c", "ip", "t", '{"value": 3}', "999", "1.0", "yes", "0.5", "7", "bad"),
        ("2023-11-14T22:13:30Z", "c", "ip", "t", None, "999", "x", None, "2", None, None),
        ("never", None, "ip", None, "24.5", "1", None, "1", None, None, ""),
    ], LOG)
    first, second, third = features.extract_features(df, seq=None).orderBy(F.col("ts").asc_nulls_last()).collect()
    assert first.asDict() | {"ts": 0, "seq": 0} == {
        "timestamp": 1700000000, "ts": 0, "client_id": "c", "topic": "t", "value": "3", "payload_length": 12, "qos": 1,
        "retain_flag": 1, "dup_flag": 0, "msgid_present": 1, "iat_sec": 0.0, "Label": "bad", "value_num": 3.0, "seq": 0}
    assert (second.iat_sec, second.payload_length, second.qos, second.dup_flag, second.msgid_present) == (9.75, 0, 0, 1, 0)
    assert (third.timestamp, third.ts, third.client_id, third.value, third.iat_sec) == (0, None, "ip", "24.5", 0.0)


def test_prefer_stated_length(spark):
    df = spark.createDataFrame([("1", "abc", "20000")], "ts STRING, payload STRING, payload_length STRING")
    assert one(features.message_fields(df, seq=None))["payload_length"] == 3
    assert one(features.message_fields(df, seq=None, prefer="payload_length"))["payload_length"] == 20000


def test_absent_columns_get_defaults(spark):
    df = spark.createDataFrame([("1", 2.5)], "time STRING, value DOUBLE")
    row = one(features.extract_features(df, seq=None))
    assert (row["client_id"], row["value"], row["value_num"], row["payload_length"]) == ("unknown", "2.5", 2.5, 3)
    assert "topic" not in row and "Label" not in row
    with pytest.raises(ValueError):
        features.message_fields(df.drop("time"), seq=None)


def test_all_timestamps_unreadable(spark):
    df = spark.createDataFrame([("x",), (None,)], "ts STRING")
    stamped = features.message_fields(df, seq=None, now=F.timestamp_seconds(F.lit(7)))
    assert [r.timestamp for r in stamped.collect()] == [7, 7]
    assert [r.timestamp for r in features.message_fields(df, seq=None).collect()] == [0, 0]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1700000000.25", "c", "ip", 't,"q"', "1", "9", "1", "1", "0", "7", "bad")], LOG)
    made = features.extract_features(df, seq=None)
    path = str(tmp_path / "features")
    assert tables.write_features(made, path, file_format="csv") == 1
    back = tables.read_features(spark, path, file_format="csv")
    assert back.collect() == made.collect()


def test_features_path():
    assert tables.features_path("x/processed_fan.csv") == "x/features_fan"
    assert tables.features_path("fan") == "features_fan"


def test_identical_rows_without_seq(spark):
    df = spark.createDataFrame([("1", "c")] * 3 + [("4", "c")], "ts STRING, client_id STRING")
    assert sorted(r.iat_sec for r in features.extract_features(df, seq=None).collect()) == [0.0, 0.0, 0.0, 3.0]
