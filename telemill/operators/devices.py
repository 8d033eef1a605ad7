"""Device types found in canonical rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.payload import with_enriched_payload
from telemill.functions.topics import repair_topic
from telemill.operators.ordered import Order, running_totals
from telemill.schemas import DEVICE_PATTERNS


SAMPLE_MERGES = 64  # groups of tasks whose samples are merged first


def classify_devices(df: DataFrame, sample: str = "Payload_sample", topic: str = "topic") -> DataFrame:
    """One row per (row, device type it mentions); a row may be of several types or none.

    All types are tested in one pass over the lower-cased text.
    """
    text = F.lower(F.concat_ws("\n", F.col(sample), F.col(topic)))
    found = [
        F.when(reduce(lambda a, b: a | b, [F.contains(F.col("_text"), F.lit(p.lower())) for p in patterns]), F.lit(name))
        for name, patterns in DEVICE_PATTERNS.items()
    ]
    return (df.withColumn("_text", text)
            .withColumn("device_type", F.explode(F.array_compact(F.array(*found))))
            .drop("_text"))


def sample_per_device(df: DataFrame, key: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """A uniform sample of at most ``n`` rows per device type, the same for the same seed and key.

    Every row draws a number from a hash of seed and key; the ``n`` smallest of a type are its sample. The input is read
    once: each task keeps the ``n`` smallest of its rows per type, those of some tasks are merged, and then those of all, so
    the last step sees at most ``SAMPLE_MERGES * n`` rows of a type, whatever the input. (Spark keeps the smallest before the
    shuffle for ``n`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``.)
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    drawn = df.withColumns({"_draw": digest, "_merge": F.spark_partition_id() % SAMPLE_MERGES})
    for keys in (("device_type", "_merge"), ("device_type",)):
        ranked = Window.partitionBy(*keys).orderBy("_draw", key)
        drawn = drawn.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n)
    return drawn.select(*df.columns)


def device_counts(classified: DataFrame) -> DataFrame:
    """Rows per device type, types without rows included."""
    counts = classified.groupBy("device_type").agg(F.count("*").alias("records"))
    known = classified.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(name) for name in DEVICE_PATTERNS])).alias("device_type"))
    return (known.join(counts, "device_type", "left")
            .select("device_type", F.coalesce("records", F.lit(0)).cast("bigint").alias("records")))


def record_index(df: DataFrame, order: Order, name: str = "record_index") -> DataFrame:
    """Number the rows of each key from zero in order."""
    return (running_totals(df, order, {name: F.lit(1)})
            .withColumn(name, F.col(name) - 1))


def replay_records(df: DataFrame, stamped_at, order: Order | None = None) -> DataFrame:
    """Classified canonical rows as publishable messages: repaired topic, enriched payload."""
    indexed = record_index(df, order or Order(("device_type",)))
    device, index = F.col("device_type"), F.col("record_index")
    return with_enriched_payload(
        indexed.withColumn("topic", repair_topic(F.col("topic"), device, index)),
        F.col("Payload_sample"), device, index, stamped_at)
