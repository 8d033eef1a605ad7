"""Received messages to traffic log rows; works on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.payload import with_identity
from telemill.functions.text import decode_payload
from telemill.functions.topics import device_from_topic

ISO_OFFSET = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
SAMPLE_CHARACTERS = 200


def collect_messages(messages: DataFrame, broker: str = "localhost", port: int = 1883,
                     keep: tuple[str, ...] = ("device_type",)) -> DataFrame:
    """One 17-column traffic log row per message (topic, payload bytes, qos, retain, ts).

    ``keep`` names further columns to carry: the resolved ``device_type`` or any message column.
    """
    text = F.col("_text")
    named = with_identity(messages.withColumn("_text", decode_payload(F.col("payload"))), text,
                          client_id="_client", device_type="_device")
    unknown = F.lit("unknown")
    device = F.when(F.col("_device") == unknown, device_from_topic(F.col("topic"))).otherwise(F.col("_device"))
    columns: dict[str, Column] = {
        "timestamp": F.date_format("ts", ISO_OFFSET),
        "src_ip": F.lit("192.168.1.unknown"),
        "src_port": F.lit("50000"),
        "dst_ip": F.lit(broker),
        "dst_port": F.lit(str(port)),
        "client_id": F.col("_client"),
        "topic": F.col("topic"),
        "qos": F.col("qos").cast("int"),
        "retain": F.coalesce(F.col("retain").cast("int"), F.lit(0)),
        "dupflag": F.lit(0),
        "payload_length": F.length(text),
        "payload_sample": F.substring(text, 1, SAMPLE_CHARACTERS),
        "packet_type": F.lit("PUBLISH"),
        "protocol": F.lit("MQTT"),
        "msgid": F.lit(None).cast("bigint"),
        "flow_stage": F.lit("broker_to_detection"),
        "label": F.lit("Unknown"),
    }
    kept = [(device if name == "device_type" else F.col(name)).alias(name) for name in keep]
    return named.select(*[column.alias(name) for name, column in columns.items()], *kept)


def collection_stats(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Messages, running time in seconds and messages per second of a batch."""
    seconds = (F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / 1_000_000
    return (df.agg(F.count("*").alias("messages"), F.coalesce(seconds, F.lit(0.0)).alias("runtime_sec"))
            .withColumn("messages_per_sec", F.when(
                F.col("runtime_sec") > 0, F.col("messages") / F.col("runtime_sec")).otherwise(F.lit(0.0))))


def interval_stats(df: DataFrame, ts: str = "ts", interval_seconds: int = 10) -> DataFrame:
    """Messages and rate per reporting interval; on a stream, set a watermark first."""
    return (df.groupBy(F.window(ts, f"{interval_seconds} seconds").alias("_window"))
            .agg(F.count("*").alias("messages"))
            .select(F.col("_window.start").alias("interval_start"), "messages",
                    (F.col("messages") / interval_seconds).alias("messages_per_sec")))
