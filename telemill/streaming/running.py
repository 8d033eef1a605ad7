"""Counts per client over a whole, endless run: keyed state that survives restarts.

A client's state is its counts (one value) and the topics that it has used (a map, so no set is ever one value). Rows of a
micro-batch are counted in the order (timestamp with nulls last, ``seq``), micro-batches in the order of their arrival. So
the counts are those of a batch run over the same rows whenever no row arrives in a micro-batch after one that it precedes.

A client's rows of one micro-batch meet in one task, with the few columns that counting needs: the source's rows per trigger
bound what a task holds. State grows with the clients and their topics; ``idle`` forgets clients that have been silent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the store that keyed state needs
COUNTS = ("messages", "topics", "qos2", "retained")
_ADDED = ("counted_qos2", "counted_retained")  # a leading underscore would lose the name on the way to Python


class RunningCounts(StatefulProcessor):
    """Adds the client's running counts, the row itself included, to every row."""

    def __init__(self, ts: str, seq: str, topic: str, idle_ms: int | None):
        self.ts, self.seq, self.topic, self.idle_ms = ts, seq, topic, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        count = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])
        text = T.StructType([T.StructField("topic", T.StringType())])
        self.counts = handle.getValueState("counts", count, self.idle_ms)
        self.seen = handle.getMapState("topics", text, T.StructType([T.StructField("seen", T.BooleanType())]), self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.sort_values([self.ts, self.seq], na_position="last", kind="stable", ignore_index=True)
        before = dict(zip(COUNTS, self.counts.get() or (0,) * len(COUNTS)))
        # a null topic is a topic too, and differs from every text
        names = frame[self.topic].map(lambda t: "-" if t is None or t != t else "+" + t)
        first = np.flatnonzero(~names.duplicated().to_numpy())
        new = [i for i in first.tolist() if not self.seen.containsKey((names.iat[i],))]
        for i in new:
            self.seen.updateValue((names.iat[i],), (True,))
        fresh = np.zeros(len(frame), np.int64)
        fresh[new] = 1
        steps = {"messages": np.ones(len(frame), np.int64), "topics": fresh, "qos2": frame.pop(_ADDED[0]).to_numpy(np.int64),
                 "retained": frame.pop(_ADDED[1]).to_numpy(np.int64)}
        for name, step in steps.items():
            frame[name] = before[name] + np.cumsum(step)
        self.counts.update(tuple(int(frame[name].iat[-1]) for name in COUNTS))
        yield frame

    def close(self) -> None:
        pass


def with_running_counts(rows: DataFrame, is_qos2: F.Column, is_retained: F.Column, ts: str = "ts", seq: str = "seq",
                        topic: str = "topic", client: str = "client_id", idle: str | None = None) -> DataFrame:
    """A stream's rows with messages, topics (distinct), qos2 and retained so far per client.

    ``idle`` (like ``"7 days"``) is how long a count or topic is remembered after it last changed, by the clock; such a query
    never runs out of work, so give it a processing-time trigger and not ``availableNow``. Keyed state lives in
    Spark's RocksDB store, which is made the session's store for queries started from now on.
    """
    spark = rows.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this library
    if spark.conf.get(STATE_STORE) != KEYED_STATE:
        spark.conf.set(STATE_STORE, KEYED_STATE)
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    marked = rows.withColumns(dict(zip(_ADDED, (is_qos2.cast("bigint"), is_retained.cast("bigint")))))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, T.LongType()) for name in COUNTS]])
    return marked.groupBy(client).transformWithStateInPandas(
        statefulProcessor=RunningCounts(ts, seq, topic, idle_ms), outputStructType=schema, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime")
