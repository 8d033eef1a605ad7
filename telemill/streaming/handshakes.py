"""Handshakes paired as they arrive: what ``qos2_pairing`` finds in a log, on a stream.

The state of a (client, message id) is its latest PUBLISH or PUBCOMP. Rows of a micro-batch are taken in the order (timestamp
with nulls last, ``seq``), micro-batches as they arrive; a PUBCOMP is answered at once, and one that finds no open PUBLISH is
unexpected, so nothing waits for a watermark. ``idle`` forgets ids that have been silent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telemill.operators.logs import handshake_steps
from telemill.streaming.running import KEYED_STATE, STATE_STORE

_LATEST = T.StructType([T.StructField("opened", T.BooleanType()), T.StructField("at", T.LongType())])


class OpenHandshakes(StatefulProcessor):
    """For every PUBCOMP the microseconds since the PUBLISH before it, null if unexpected or without a timestamp."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", _LATEST, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.latest.get()
        opened, since = before if before is not None else (False, None)
        for row in sorted(rows, key=lambda r: (r["micros"] is None, r["micros"] or 0, r["seq"])):
            opens, at = row["opens"], row["micros"]
            if not opens:
                known = opened and since is not None and at is not None
                yield Row(client_id=row["client_id"], message_id=row["message_id"], micros=at, seq=row["seq"],
                          waited=at - since if known else None, unexpected=not opened)
            opened, since = opens, at
        self.latest.update((opened, since))

    def close(self) -> None:
        pass


def qos2_pairing_stream(rows: DataFrame, ts: str = "ts", seq: str = "seq", idle: str | None = None) -> DataFrame:
    """client_id, message_id, ts, seq, handshake_sec and unexpected of every PUBCOMP, as ``qos2_pairing`` gives them.

    The same rows if none arrives in a micro-batch after one that it precedes. A message id's rows of a micro-batch meet in
    one task. ``idle`` as for ``with_running_counts``.
    """
    spark = rows.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this library
    if spark.conf.get(STATE_STORE) != KEYED_STATE:
        spark.conf.set(STATE_STORE, KEYED_STATE)
    publish, complete = handshake_steps()
    steps = rows.where(publish | complete).select(
        "client_id", "message_id", F.unix_micros(ts).alias("micros"), F.col(seq).alias("seq"), publish.alias("opens"))
    kinds = {field.name: field.dataType for field in steps.schema.fields}
    out = T.StructType([
        *[T.StructField(name, kinds[name]) for name in ("client_id", "message_id", "micros", "seq")],
        T.StructField("waited", T.LongType()), T.StructField("unexpected", T.BooleanType())])
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    paired = steps.groupBy("client_id", "message_id").transformWithState(
        statefulProcessor=OpenHandshakes(idle_ms), outputStructType=out, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime")
    return paired.select("client_id", "message_id", F.timestamp_micros("micros").alias(ts), F.col("seq").alias(seq),
                         (F.col("waited") / 1_000_000).alias("handshake_sec"), "unexpected")
