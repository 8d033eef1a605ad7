"""Small builders shared by the tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FEATURE_SCHEMA = ("seq BIGINT, ts TIMESTAMP, client_id STRING, topic STRING, payload_length BIGINT, qos INT, "
                  "retain_flag INT")


def evaluate(spark, function, inputs: list) -> list:
    """Results of a column function over single inputs, in order."""
    kind = "BINARY" if any(isinstance(i, (bytes, bytearray)) for i in inputs) else "STRING"
    df = spark.createDataFrame(list(enumerate(inputs)), f"i INT, x {kind}")
    return [row[1] for row in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def one(df: DataFrame) -> dict:
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def at(seconds: float | None) -> datetime | None:
    return None if seconds is None else START + timedelta(seconds=seconds)


def feature_rows(spark, rows: list[tuple]) -> DataFrame:
    """Rows (seconds, client, topic, payload_length, qos, retain) with their position as ``seq``."""
    return spark.createDataFrame(
        [(i, at(s), *rest) for i, (s, *rest) in enumerate(rows)], FEATURE_SCHEMA)


def random_features(seed: int, n: int) -> list[tuple]:
    """Feature rows with a dominant client, ties, null timestamps and null topics."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        client = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        topic = rng.choice([None, "#", "$SYS/x", "a*b", *[f"t/{i}" for i in range(30)]])
        rows.append((
            None if rng.random() < 0.05 else rng.choice([rng.randint(0, 40), round(rng.uniform(0, 20000), 3)]),
            client, topic, rng.choice([None, 0, 1, 50, 10000, 10001]), rng.choice([None, 0, 1, 2, 2]),
            rng.choice([0, 1, 1])))
    return rows


def in_order(rows: list[tuple]) -> list[tuple]:
    """(seq, row) in the total order: timestamp with nulls last, then position."""
    return sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0]))


def as_text(column: str) -> Column:
    return F.col(column).cast("string")
