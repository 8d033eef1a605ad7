"""Golden cases of the scalar functions."""

import pytest
from helpers import evaluate
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemill.functions import numbers, payload, text, times, topics
from telemill.operators import canonical, features


def test_sanitize_text(spark):
    cases = {"a\tb  c": "ab c", None: "", "": "", " x ": "x", "é1\n2": "12", "a" * 200: "a" * 120}
    assert evaluate(spark, text.sanitize_text, list(cases)) == list(cases.values())


def test_decode_hex_payload(spark):
    cases = {
        "32:34:2e:30:37": "24.07", "24.07 75.32": "24.07 75.32", "1234": "4", "ff41": "A", "abc": "0abc", "": "",
        "e282 41": "A", "ffff": "ffff", "00" * 130: "00" * 120, None: "", "48 49": "HI", "zz\t1": "zz1",
    }
    assert evaluate(spark, text.decode_hex_payload, list(cases)) == list(cases.values())


def python_decode(value: str) -> str:
    """The decoder as its description reads, byte by byte."""
    digits = value.replace(":", "").replace(" ", "")
    padded = ("0" if len(digits) % 2 else "") + digits
    raw = bytes(int(padded[i:i + 2], 16) for i in range(0, len(padded), 2))
    kept = "".join(c for c in raw.decode("utf-8", "ignore") if " " <= c <= "~")
    return " ".join(kept.split())[:120] or raw[:120].hex()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=40, max_size=40))
def test_decode_hex_payload_of_any_bytes(spark, payloads):
    values = [p.hex() for p in payloads]
    assert evaluate(spark, text.decode_hex_payload, values) == [python_decode(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=40), min_size=40, max_size=40))
def test_decode_payload_drops_only_bad_bytes(spark, payloads):
    expected = [p.decode("utf-8", "ignore") for p in payloads]
    assert evaluate(spark, text.decode_payload, [bytearray(p) for p in payloads]) == expected


def test_decode_payload_keeps_a_genuine_replacement_character(spark):
    assert evaluate(spark, text.decode_payload, [bytearray(b"a\xff\xef\xbf\xbdb\xe2\x82")]) == ["a�b"]


def test_hex_length(spark):
    cases = {"32:34": 2, "abc": 1, "24.07 75.32": 11, "": 0, None: 0}
    assert evaluate(spark, text.hex_length, list(cases)) == list(cases.values())


def test_timestamps(spark):
    cases = {
        "1700000000.5": "2023-11-14T22:13:20.500000Z", "2024-01-01T00:00:00Z": "2024-01-01T00:00:00.000000Z",
        "2024-01-01 10:00:00.25": "2024-01-01T10:00:00.250000Z", "2024-01-01T02:00:00+02:00": "2024-01-01T00:00:00.000000Z",
        "1/2/2024 3:04:05": "2024-01-02T03:04:05.000000Z", " 12 ": "1970-01-01T00:00:12.000000Z",
        "bad": "", "": "", None: "", "nan": "", "1e400": "", "1.5d": "", "1700000000000": "",
    }
    assert evaluate(spark, lambda c: times.format_ts(times.parse_ts(c)), list(cases)) == list(cases.values())


def test_packet_type(spark):
    cases = {"3": "PUBLISH", "3.0": "PUBLISH", "16": "16", "0": "0", "publish": "PUBLISH", "": "UNKNOWN",
             None: "UNKNOWN", "15": "AUTH", "3.5": "3.5"}
    assert evaluate(spark, canonical.packet_type, list(cases)) == list(cases.values())


def test_bool_flag(spark):
    cases = {"True": 1, "1": 1, "YES": 1, "t": 1, " y ": 1, "0": 0, "1.0": 0, "2": 0, None: 0}
    assert evaluate(spark, text.bool_flag, list(cases)) == list(cases.values())


def test_feature_flag(spark):
    cases = {"2": 1, "0.5": 0, "-1": 1, "0": 0, "yes": 1, "True": 1, "on": 0, None: 0}
    assert evaluate(spark, features.flag, list(cases)) == list(cases.values())


def test_numbers(spark):
    cases = {"7": 7, " 3.0 ": 3, "2e2": 200, "1.5": None, "1.5d": None, "1_000": None, "": None, None: None,
             "inf": None, "99999999999999999999": None}
    assert evaluate(spark, numbers.to_whole_number, list(cases)) == list(cases.values())


VALUES = {
    '{"device_id":"x","value":24.5}': ("24.5", 24.5),
    '{"z":"a","b":3,"a":1}': ("3", 3.0),
    '{"q":true,"b":2}': ("true", 1.0),
    '{"value":"hi"}': ("hi", None),
    '{"unit":"c"}': (None, None),
    '{"a":"3"}': (None, None),
    '{"temp":1,"val":2}': ("2", 2.0),
    '{"value":null,"b":2}': (None, None),
    '{"a":1,"b":3,"a":"x"}': ("3", 3.0),
    '{"value":28.0}': ("28.0", 28.0),
    '{"value":{"x":1}}': ('{"x":1}', None),
    "24.07": ("24.07", 24.07),
    "24.07 75.32": (None, None),
    "[1]": (None, None),
    '{"a":1} tail': (None, None),
    '{"a":1} }': (None, None),
    "{'a':1}": (None, None),
    "": (None, None),
    None: (None, None),
}


def test_extract_value(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i INT, p STRING")
    rows = payload.with_extracted_value(df, F.col("p")).orderBy("i").collect()
    assert {r.p: (r.value, r.value_num) for r in rows} == VALUES


def test_identity(spark):
    cases = {
        '{"device_id":"d","client_id":"c","device_type":"T"}': ("d", "T"),
        '{"client_id":"c"}': ("c", "unknown"), '{"x":1}': ("unknown", "unknown"), ' {"device_id":"d"}': ("unknown", "unknown"),
        '{"device_id":5}': ("5", "unknown"), "{bad": ("unknown", "unknown"), "text": ("unknown", "unknown"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p STRING")
    rows = payload.with_identity(df, F.col("p")).collect()
    assert {r.p: (r.client_id, r.device_type) for r in rows} == cases


def test_device_from_topic(spark):
    cases = {"site/canonical/temperature/device_001/telemetry": "temperature", "city/air/s1": "air",
             "a/b": "unknown", "a": "unknown", None: "unknown"}
    assert evaluate(spark, topics.device_from_topic, list(cases)) == list(cases.values())


def python_match(topic: str, topic_filter: str) -> bool:
    """Level-by-level filter matching."""
    have, want = topic.split("/"), topic_filter.split("/")
    if have[0].startswith("$") and want[0] in "+#":
        return False
    for i, level in enumerate(want):
        if level == "#":
            return True
        if i >= len(have) or (level != "+" and level != have[i]):
            return False
    return len(have) == len(want)


LEVELS = st.sampled_from(["a", "b", "", "$SYS", "a.b"])
TOPICS = st.lists(LEVELS, min_size=1, max_size=4).map("/".join)
WILD = st.lists(st.sampled_from(["a", "b", "", "$SYS", "a.b", "+"]), min_size=1, max_size=4)
FILTERS = st.tuples(WILD, st.booleans()).map(lambda f: "/".join(f[0] + (["#"] if f[1] else [])))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TOPICS, min_size=20, max_size=20), FILTERS | st.just("#"))
def test_topic_matches(spark, names, topic_filter):
    got = evaluate(spark, lambda c: topics.topic_matches(c, topic_filter), names)
    assert got == [python_match(name, topic_filter) for name in names]


@pytest.mark.parametrize("options, first", [
    ({"topics": ["x"], "zone": 2}, "x"), ({"all_zones": True, "zone": 2}, "site/tenantA/+/+/+/telemetry"),
    ({"zone": 3}, "site/tenantA/zone3/+/+/telemetry"), ({"device_type": "co2"}, "site/tenantA/+/co2/+/telemetry"),
    ({}, "site/tenantA/zone1/temperature/+/telemetry")])
def test_subscription_filters(options, first):
    assert topics.subscription_filters(**options)[0] == first


def test_enrich_payload(spark):
    df = spark.createDataFrame([(0, '{"a":1.0,"device_type":"old"}'), (1, "{}"), (2, "x" * 150), (3, None)], "i INT, p STRING")
    rows = payload.with_enriched_payload(df, F.col("p"), F.lit("Fan"), F.col("i"), F.lit("T")).orderBy("i").collect()
    assert rows[0].payload == ('{"a":1.0,"device_type":"Fan","canonical_source":"dataset_canonical",'
                               '"simulator_timestamp":"T","canonical_record_id":0,"flow_stage":"canonical_to_mqtt"}')
    added = ('{"canonical_source":"dataset_canonical","device_type":"Fan","simulator_timestamp":"T",'
             '"canonical_record_id":%d,"flow_stage":"canonical_to_mqtt"}')
    assert rows[1].payload == added % 1 and rows[3].payload == added % 3
    assert rows[2].payload == ('{"device_type":"Fan","canonical_source":"dataset_canonical","raw_payload":"'
                               + "x" * 100 + '","simulator_timestamp":"T"}')
