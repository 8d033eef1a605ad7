"""Time windows against brute force."""

from collections import Counter

import pytest
from helpers import at, feature_rows, random_features

from telemill.operators import windows
from telemill.operators.detection import Rules

RULES = Rules().override(
    flood_detection={"threshold": 3, "window_seconds": 300}, topic_enumeration={"threshold": 2, "window_seconds": 300},
    qos_abuse={"threshold": 2, "window_seconds": 600}, retain_abuse={"threshold": 2, "window_seconds": 600})
COUNTS = {
    "flood_detection": lambda group: len(group),
    "topic_enumeration": lambda group: len({r[2] for r in group}),
    "qos_abuse": lambda group: sum(r[4] == 2 for r in group),
    "retain_abuse": lambda group: sum(r[5] == 1 for r in group),
}


def test_tumbling(spark):
    rows = random_features(11, 500)
    expected = Counter()
    for key, count in COUNTS.items():
        width, groups = RULES[key].window_seconds, {}
        for row in rows:
            if row[0] is not None:
                groups.setdefault((row[1], row[0] // width), []).append(row)
        for (client, _), group in groups.items():
            if count(group) > RULES[key].threshold:
                expected[client, RULES[key].name, count(group)] += 1
    got = windows.detect_windowed(feature_rows(spark, rows), RULES).collect()
    assert Counter((r.client_id, r.rule_name, r.observed) for r in got) == expected


@pytest.mark.parametrize("options", [{}, {"max_rows": 9}])
def test_sliding(spark, options):
    rows = [r for r in random_features(12, 300) if r[0] is not None]
    rows = [(float(i) * 7 if i % 3 else float(i // 9) * 60, *r[1:]) for i, r in enumerate(rows)]
    # rows of one instant are counted up to the row itself
    ordered = sorted(enumerate(rows), key=lambda r: (r[1][0], r[0]))
    measures = ("messages", "topics", "qos2", "retained")
    expected = {}
    for place, (seq, row) in enumerate(ordered):
        for width in (300, 40):
            group = [r for _, r in ordered[:place + 1] if r[1] == row[1] and row[0] - width <= r[0]]
            expected[seq, width] = tuple(COUNTS[k](group) for k in ("flood_detection", "topic_enumeration", "qos_abuse", "retain_abuse"))
    got = windows.sliding_counts(feature_rows(spark, rows), {300: measures, 40: measures[:2]}, **options).collect()
    assert {(r.seq, 300): tuple(r[f"{m}_300"] for m in measures) for r in got} == {k: v for k, v in expected.items() if k[1] == 300}
    assert {(r.seq, 40): (r.messages_40, r.topics_40) for r in got} == {k: v[:2] for k, v in expected.items() if k[1] == 40}


def test_reconnect_and_duplicate(spark):
    schema = "client_id STRING, ts TIMESTAMP, packet_type STRING, src_ip STRING"
    rows = [("a", at(i), "CONNECT", "1") for i in range(11)] + [("b", at(i), "CONNECT", "1") for i in range(10)]
    rows += [("c", at(0), "PUBLISH", "1"), ("c", at(59), "PUBLISH", "2"), ("d", at(0), "PUBLISH", "1"),
             ("d", at(61), "PUBLISH", "2"), ("e", at(0), "PUBLISH", ""), ("e", at(1), "PUBLISH", "1")]
    df = spark.createDataFrame(rows, schema)
    assert [(r.client_id, r.observed) for r in windows.reconnect_storm(df).collect()] == [("a", 11)]
    assert [(r.client_id, r.observed) for r in windows.duplicate_client(df).collect()] == [("c", 2)]
