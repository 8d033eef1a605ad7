"""Inputs that once were dropped, cut or misread."""

import gzip
from datetime import datetime

import pytest
from helpers import evaluate, feature_rows
from pyspark.sql import functions as F

from telemill import session
from telemill.functions import numbers, payload, times
from telemill.operators import detection, devices
from telemill.sources import raw, tables

ALERT = ("timestamp STRING, rule_name STRING, severity STRING, client_id STRING, topic STRING, description STRING, "
         "action STRING, blocked BOOLEAN")


def test_numbers_have_no_bounds(spark):
    written = ["1e100", "1e-200", "5e307", "1e400", "-1e400", "1" * 250, "0.5", "1.5d", "1_000", ""]
    assert evaluate(spark, numbers.to_number, written) == [
        1e100, 1e-200, 5e307, None, None, float("1" * 250), 0.5, None, None, None]
    assert evaluate(spark, lambda x: numbers.numeric_field(x, None), ["0" * 22 + "123", "9" * 19, "9" * 18, "2e3", "1e400"]) == [
        123, None, int("9" * 18), 2000, None]


@pytest.mark.parametrize("written, expected", [
    ("2024/01/02", datetime(2024, 1, 2)),
    ("1/2/2024 10:00:00.5", datetime(2024, 1, 2, 10, 0, 0, 500000)),
    ("1/2/2024 10:00:00 PM", datetime(2024, 1, 2, 22)),
    ("Jan 1 2024 10:00:00", datetime(2024, 1, 1, 10)),
    ("January 5, 2024", datetime(2024, 1, 5)),
    ("Mon, 01 Jan 2024 00:00:00 GMT", datetime(2024, 1, 1)),
    ("01-02-2024 10:00", datetime(2024, 1, 2, 10)),
    ("2024-01-01 10:00:00,123", datetime(2024, 1, 1, 10, 0, 0, 123000)),
    ("Jan 5, 2024 10:11:12.123456789 UTC", datetime(2024, 1, 5, 10, 11, 12, 123456)),
    ("02 January 2024", datetime(2024, 1, 2)),
    ("5 Jan 2024 10:00:00.123", datetime(2024, 1, 5, 10, 0, 0, 123000)),
    ("Jan 5, 2024 3:04 PM", datetime(2024, 1, 5, 15, 4)),
    ("Tue Jan  2 10:00:00 2024", datetime(2024, 1, 2, 10)),
    ("Tue Jan  2 10:00:00 UTC 2024", datetime(2024, 1, 2, 10)),
    ("2024-01-02 10:00 PM", datetime(2024, 1, 2, 22)),
    ("1/2/2024 12:30 am", datetime(2024, 1, 2, 0, 30)),
    ("1/2/24", datetime(2024, 1, 2)), ("31.12.99", datetime(1999, 12, 31)), ("5-Mar-68", datetime(2068, 3, 5)),
    ("2024.01.02", datetime(2024, 1, 2)), ("13/01/2024", datetime(2024, 1, 13)), ("2 Sept 2024", datetime(2024, 9, 2)),
    ("5 JANUARY 2024", datetime(2024, 1, 5)), ("Mon, 02 Jan 2024 10:00:00 +0530", datetime(2024, 1, 2, 4, 30)),
    ("5 January 2024 10:00 -0800", datetime(2024, 1, 5, 18)), ("Jan 5 2024 10:00 EST", datetime(2024, 1, 5, 15)),
    ("Foo 5, 2024", None), ("2024-01-02 25:00", None), ("2024-02-30 10:00 PM", None), ("Jan 5 2024 13:00 PM", None),
    ("no date", None),
])
def test_date_spellings(spark, written, expected):
    got = evaluate(spark, lambda x: F.date_format(times.parse_ts(x), "yyyy-MM-dd HH:mm:ss.SSSSSS"), [written])
    assert got == [expected and expected.strftime("%Y-%m-%d %H:%M:%S.%f")]


def test_json_objects(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1}],[{"b":2}', '{"a":1},"y":{"b":2}', '{"a":1}{"b":2}', '{"a":1', "[1]", "", None,
             '{"a":1,"a":2}', "{}"]
    assert evaluate(spark, payload.is_json_object, texts) == [
        True, True, False, False, False, False, False, False, None, True, True]


ALERTS = [("2024", "r", "HIGH", " c2 ", "a\nb", 'say "x", y', "BLOCK", True), (None, "", "LOW", "", None, " \\ ", "ALERT", False),
          ("t", "r,s", "LOW", "c\r\nd", "", "\t", "ALERT", None)]


def test_alerts_csv_keeps_every_text(spark, tmp_path):
    path = str(tmp_path / "alerts")
    made = spark.createDataFrame(ALERTS, ALERT)
    assert tables.write_alerts(made, path) == 3 and tables.write_alerts(made, path) == 3
    assert sorted(map(str, tables.read_alerts(spark, path).collect())) == sorted([str(r) for r in made.collect()] * 2)


def test_canonical_csv_is_typed(spark, tmp_path):
    made = spark.createDataFrame([(1, None, " x ", ""), (0, 5, "", "two\nlines")], "qos BIGINT, msgid BIGINT, topic STRING, Label STRING")
    path = str(tmp_path / "canonical")
    tables.write_canonical(made, path, file_format="csv")
    back = tables.read_canonical(spark, path, "csv")
    assert back.dtypes == made.dtypes and set(back.collect()) == set(made.collect())


def test_records_over_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\ntimestamp,client_id,topic,payload,protocol\n1700000000,c1,t/1,"line1\nline2",mqtt\n'
                                    "1700000001,c2,t/2,x,mqtt\n")
    rows = raw.canonicalize_inputs(spark, [str(tmp_path)]).select("client_id").collect()
    assert sorted(r.client_id for r in rows) == ["c1", "c2"]


def test_headers_take_a_fixed_number_of_jobs(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"f {i}.csv").write_text(f"timestamp,topic,h{i % 3}\n1,t{i},x\n")
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    frames = raw.scan_raw(spark, [str(tmp_path)])
    jobs = context.statusTracker().getJobIdsForGroup("headers")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(frames) == 3 and sum(f.count() for f in frames) == 50
    assert len(jobs) <= 6


def test_attack_log_columns_go_by_name(spark, tmp_path):
    kind, layout = next(iter(tables.ATTACK_LOG_SCHEMAS.items()))
    names = [part.split()[0] for part in layout.split(",")]
    path = tmp_path / "log.csv"
    path.write_text(",".join(reversed(names)) + "\n" + ",".join("1" if n != "timestamp" else "1700000000" for n in reversed(names)) + "\n")
    row = tables.read_attack_log(spark, str(path), kind).first()
    assert str(row["timestamp"]) == "1700000000"


class FakeSession:
    def __init__(self, master, **conf):
        self.conf = self
        self.values = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = type("Context", (), {"master": master})()

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_scratch_folder():
    assert session.shared_folder(FakeSession("spark://x", spark_checkpoint_dir="hdfs://c/")) == "hdfs://c"
    assert session.shared_folder(FakeSession("local[2]", spark_sql_warehouse_dir="file:/w")).startswith("file:/w/")
    assert session.shared_folder(FakeSession("yarn", spark_sql_warehouse_dir="s3a://b/w")).startswith("s3a://b/w/")
    with pytest.raises(ValueError):
        session.shared_folder(FakeSession("spark://x", spark_sql_warehouse_dir="file:/w"))


@pytest.mark.parametrize("n", [1, 10, 1000, 1001])
def test_sample_of_repeated_keys(spark, n):
    rows = [("a", i % 7, i) for i in range(3000)] + [("b", i, i) for i in range(900)] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "device_type STRING, key INT, x INT")
    got = {r.device_type: r["count"] for r in devices.sample_per_device(df, "key", n).groupBy("device_type").count().collect()}
    assert got == {"a": min(n, 3000), "b": min(n, 900), "c": 1}


def test_latest_alerts(spark):
    rows = feature_rows(spark, [(0, "a", "#", 5, 0, 0), (None, "a", "t", 0, 0, 0), (0, "b", "$SYS/#", 0, 0, 0)])
    made = detection.detect(rows, keep=("seq",))
    latest = {(r.dimension, r.name) for r in detection.alert_summary(made, 1).collect()}
    assert latest == {("severity", "MEDIUM"), ("action", "ALERT")}  # the alert without a timestamp
    two = {(r.dimension, r.name): r.alerts for r in detection.alert_summary(made, 2).collect()}
    assert two[("severity", "HIGH")] == 1  # of the row before it the check made last


def test_headers_with_line_breaks_and_long_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"time\nstamp",client_id,"say ""x"""\n1700000000,c1,y\n')
    names = [f"column {i}" for i in range(5000)]
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf\r\n\r\n" + ",".join(names).encode() + b"\r\n" + b"1," * 4999 + b"1\r\n")
    (tmp_path / "c.csv").write_text("only,a,header")
    (tmp_path / "d.csv").write_text("\n \n")
    with gzip.open(tmp_path / "e.csv.gz", "wt") as file:
        file.write("timestamp,topic\n1,t\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv", "d.csv", "e.csv.gz")]
    assert list(raw.read_headers(spark, paths).values()) == [
        ("time\nstamp", "client_id", 'say "x"'), tuple(names), ("only", "a", "header"), ("timestamp", "topic")]
    frame = raw.scan_raw(spark, paths[:1])[0]
    assert frame.columns == ["time\nstamp", "client_id", 'say "x"'] and [tuple(r) for r in frame.collect()] == [("1700000000", "c1", "y")]


def test_headers_read_the_beginning_only(spark, tmp_path, monkeypatch):
    (tmp_path / "large.csv").write_text("timestamp,topic\n" + "1,t\n" * 500_000)
    sizes, read = [], raw._beginning
    monkeypatch.setattr(raw, "_beginning", lambda *a: sizes.append(len(text := read(*a))) or text)
    assert raw.read_headers(spark, [str(tmp_path / "large.csv")]) == {str(tmp_path / "large.csv"): ("timestamp", "topic")}
    assert sizes == [raw.HEADER_BYTES]
    with pytest.raises(Exception, match="(?i)not exist|No such"):
        raw.read_headers(spark, [str(tmp_path / "absent.csv")])
