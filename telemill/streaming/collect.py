"""Traffic collection as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from telemill.operators.messages import collect_messages, interval_stats
from telemill.operators.subscriptions import subscribed
from telemill.streaming.sinks import append_to_table


def collect_stream(messages: DataFrame, filters: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Traffic log rows of the messages under any of the filters (default: all)."""
    return collect_messages(subscribed(messages, filters) if filters else messages, keep=keep)


def append_traffic_log(messages: DataFrame, path: str, checkpoint: str, filters: list[str] | None = None,
                       keep: tuple[str, ...] = (), **options) -> StreamingQuery:
    return append_to_table(collect_stream(messages, filters, keep), path, checkpoint, **options)


def stats_stream(messages: DataFrame, watermark: str = "30 seconds", interval_seconds: int = 10) -> DataFrame:
    """Messages and rate per reporting interval, final once the watermark has passed it."""
    return interval_stats(messages.withWatermark("ts", watermark), "ts", interval_seconds)
