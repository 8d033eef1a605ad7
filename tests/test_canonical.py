"""Header styles and canonicalisation."""

import pytest
from helpers import one
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from telemill.operators import canonical
from telemill.schemas import CANONICAL_COLUMNS
from telemill.sources import raw, tables


def raw_table(spark, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"c{i} STRING" for i in range(len(names))))
    return df.toDF(*names)


def test_capture_style(spark):
    row = one(canonical.canonicalize(raw_table(spark, **{
        "frame.time_epoch": "1700000000.5", "ip.src": "10.0.0.1", "tcp.srcport": "5000", "mqtt.topic": " t/1 ",
        "mqtt.qos": "2", "mqtt.retain": "True", "mqtt.dupflag": "0", "mqtt.msgtype": "3", "mqtt.msg": "32:34",
        "mqtt.msgid": "", "mqtt.conack.val": "0"})))
    assert list(row) == CANONICAL_COLUMNS
    assert (row["timestamp"], row["client_id"], row["topic"]) == ("2023-11-14T22:13:20.500000Z", "10.0.0.1", "t/1")
    assert (row["qos"], row["retain"], row["dupflag"], row["payload_length"]) == (2, 1, 0, 2)
    assert (row["Payload_sample"], row["packet_type"], row["protocol"]) == ("24", "PUBLISH", "MQTT")
    assert (row["Label"], row["msgid"], row["username"], row["connack_code"]) == ("unknown", None, "", "0")


def test_alternative_style(spark):
    row = one(canonical.canonicalize(raw_table(
        spark, Time="2024-01-01T00:00:00Z", source_ip="1.1.1.1", sport="1", device_id="d", publish_topic="p",
        request_qos="x", retain_flag="1", payload_sample="a\tb", message_type="publish", app_protocol=" mqtt",
        attack_type="dos")))
    assert (row["client_id"], row["topic"], row["qos"], row["retain"]) == ("d", "p", 0, 1)
    assert (row["Payload_sample"], row["payload_length"], row["Label"], row["protocol"]) == ("ab", 3, "dos", "MQTT")


def test_alias_order_and_case(spark):
    """`time` comes before `Time`; headers may carry blanks and dots, whatever the session's case setting."""
    row = one(canonical.canonicalize(raw_table(
        spark, **{" Time": "bad", "time ": "5", "Topic": "T", "protocol": "MQTT"})))
    assert (row["timestamp"], row["topic"]) == ("1970-01-01T00:00:05.000000Z", "T")


@pytest.mark.parametrize("columns", [
    {"topic": "t", "protocol": "MQTT"},                      # no timestamp column
    {"timestamp": "bad", "protocol": "MQTT"},                # unreadable timestamp
    {"timestamp": "1", "topic": "t"},                        # protocol unknown
    {"timestamp": "1", "protocol": "MQIsdp"},                # protocol not allowed
])
def test_dropped_rows(spark, columns):
    assert canonical.canonicalize(raw_table(spark, **columns)).count() == 0


def test_payload_length_is_decided_by_column(spark):
    """A stated length column wins even where it is null."""
    table = raw_table(spark, **{"timestamp": "1", "protocol": "MQTT", "payload_len": None, "mqtt.msg": "3234"})
    assert one(canonical.canonicalize(table))["payload_length"] is None
    for columns, length in [({"payload": "abc", "mqtt.msg": "zz z"}, 4), ({"payload": "abc"}, 3),
                            ({"tcp.payload": "0a:0b"}, 2), ({"mqtt.len": "9"}, 9), ({}, None)]:
        table = raw_table(spark, timestamp="1", protocol="MQTT", **columns)
        assert one(canonical.canonicalize(table))["payload_length"] == length


def test_payload_sample_is_decided_by_row(spark):
    table = raw_table(spark, **{"timestamp": "1", "protocol": "MQTT", "payload_sample": "\t", "payload": None,
                                "mqtt.msg": "", "mqtt.willmsg": "4142", "tcp.payload": "43"})
    assert one(canonical.canonicalize(table))["Payload_sample"] == "AB"


def test_allowed_protocols():
    assert canonical.allowed_protocols(" mqtt, coap,,MQTT") == ["MQTT", "COAP"]
    assert len(canonical.allowed_protocols()) == 24
    with pytest.raises(ValueError):
        canonical.allowed_protocols(" , ")


def write(path, text):
    path.write_text(text)
    return str(path)


def test_scan_groups_files_by_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", 'Time,time,topic,protocol\n9,1,"x,""y""",MQTT\n9,2,NA,MQTT\n')
    write(folder / "b.csv", "frame.time_epoch,mqtt.topic\n3,t\n")
    write(folder / "c.csv", "Time,time,topic,protocol\n9,4,z,ftp\n")
    write(folder / "empty.csv", "")
    write(folder / "note.txt", "timestamp,protocol\n1,MQTT\n")
    single = write(tmp_path / "d.csv", "ts,topic,protocol\nnull,t,MQTT\n6,u,coap\n")
    inputs = [str(folder), single, single, str(tmp_path / "missing")]
    assert len(raw.list_inputs(spark, inputs)) == 4  # files without any content are not listed
    assert sorted(len(f.columns) for f in raw.scan_raw(spark, inputs)) == [2, 3, 4]
    rows = raw.canonicalize_inputs(spark, inputs).orderBy("timestamp").collect()
    assert [(r.timestamp[17:19], r.topic, r.protocol) for r in rows] == [
        ("01", 'x,"y"', "MQTT"), ("02", "", "MQTT"), ("03", "t", "MQTT"), ("06", "u", "COAP")]
    with pytest.raises(FileNotFoundError):
        raw.canonicalize_inputs(spark, [str(tmp_path / "missing")])


def test_write_needs_force(spark, tmp_path):
    table = canonical.canonicalize(raw_table(spark, timestamp="1", protocol="MQTT"))
    path = str(tmp_path / "canonical")
    assert tables.write_canonical(table, path) == 1
    with pytest.raises(Exception):
        tables.write_canonical(table, path)
    assert tables.write_canonical(table.unionAll(table), path, force=True) == 2
    assert tables.read_canonical(spark, path).columns == CANONICAL_COLUMNS


def test_scan_mqtt(spark):
    df = spark.createDataFrame([("MQTT-TLS",), ("mqtt",), ("COAP",), (None,)], "protocol STRING")
    assert tables.scan_mqtt(df).count() == 2


def test_canonicalize_needs_no_shuffle(spark):
    table = raw_table(spark, timestamp="1", protocol="MQTT").withColumn("x", F.lit(1))
    plan = canonical.canonicalize(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_unreadable_files_fail(spark, tmp_path):
    """A file whose header can't be read isn't left out like one without a header."""
    (tmp_path / "a.csv").write_text("timestamp,protocol\n1,MQTT\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "b.csv.gz").write_bytes(b"not compressed")
    assert len(raw.scan_raw(spark, [str(tmp_path)])) == 1
    with pytest.raises((PySparkException, Py4JJavaError), match="b.csv.gz"):
        raw.scan_raw(spark, [str(tmp_path)], pattern="*.csv*")


def test_rejected_rows_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "timestamp,protocol,topic\n1,MQTT,a\nnever,MQTT,b\n,FTP,c\n2,FTP,d\n3,FTP,e\n4,MQTT,f,surplus\n5,MQTT\n")
    (tmp_path / "b.csv").write_text('Time,protocol\n1,MQTT\n"never\n",MQTT\n')
    rejects = []
    rows = raw.canonicalize_inputs(spark, [str(tmp_path)], rejects=rejects)
    assert sorted(map(tuple, rows.select("topic", "protocol").collect())) == [
        ("", "MQTT"), ("", "MQTT"), ("a", "MQTT"), ("f", "MQTT")]
    assert [o.get for o in rejects] == [
        {"malformed": 2}, {"malformed": 0}, {"rows": 7, "no_timestamp": 2, "protocol": 2},
        {"rows": 2, "no_timestamp": 1, "protocol": 0}]
    plain = raw.canonicalize_inputs(spark, [str(tmp_path)])
    assert sorted(plain.collect()) == sorted(rows.collect())
