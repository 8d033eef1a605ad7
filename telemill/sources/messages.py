"""Unbounded message source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telemill.schemas import MESSAGE_SCHEMA


def message_stream(spark: SparkSession, path: str, file_format: str = "parquet", schema: str | StructType = MESSAGE_SCHEMA,
                   files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Messages from files that arrive in a folder."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def kafka_messages(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Messages from Kafka: record key as topic, value as payload, headers for the delivery flags.

    Needs the Kafka connector package on the class path.
    """
    records = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
               .option("subscribe", topics).option("includeHeaders", "true").options(**options).load())

    def header(name: str):
        return F.get(F.filter("headers", lambda h: h["key"] == name), F.lit(0))["value"].cast("string")

    return records.select(
        F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("topic"),
        F.col("value").alias("payload"),
        F.coalesce(header("qos").try_cast("int"), F.lit(0)).alias("qos"),
        F.coalesce(header("retain").try_cast("boolean"), F.lit(False)).alias("retain"),
        F.col("timestamp").alias("ts"))
