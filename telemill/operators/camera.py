"""Camera messages: topic, class and the fields of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.payload import is_json_object
from telemill.schemas import CAMERA_CLASSES, CAMERA_SCHEMAS

# --- fixed values: fields shown per class and what stands for a missing one ---
SHOWN_FIELDS = {
    "status": {"status": "unknown", "temperature": 0.0, "cpu_usage": 0.0, "recording": False},
    "motion": {"confidence": 0.0, "motion_area_percent": 0.0, "alert_level": "unknown"},
    "security": {"event_type": "unknown", "severity": "info", "confidence": 0.0},
    "system": {"event_type": "unknown", "requires_attention": False},
    "stream": {"current_fps": 0, "bitrate_kbps": 0, "quality_score": 0.0},
}


def camera_class(topic: Column) -> Column:
    """First class whose name occurs anywhere in the topic, null if none does."""
    return F.coalesce(*[F.when(F.contains(topic, F.lit(name)), F.lit(name)) for name in CAMERA_CLASSES])


def parse_camera_topic(df: DataFrame) -> DataFrame:
    """Add zone, camera and message type; drops rows with fewer than five levels or without a JSON object."""
    levels = F.split("topic", "/")
    return (df.where((F.size(levels) >= 5) & is_json_object(F.col("payload")))
            .withColumns({"zone": F.get(levels, F.lit(1)), "camera_id": F.get(levels, F.lit(3)),
                          "message_type": F.get(levels, F.lit(4))}))


def route_camera(df: DataFrame) -> DataFrame:
    """Parsed camera rows with their class."""
    return parse_camera_topic(df).withColumn("camera_class", camera_class(F.col("topic")))


def _of_class(df: DataFrame, name: str) -> DataFrame:
    """Routed rows of one class; the class is told from the topic first, so other payloads are not parsed."""
    return route_camera(df.where(camera_class(F.col("topic")) == name))


def camera_stats(df: DataFrame) -> DataFrame:
    """Messages per class, classes without messages included; ``total`` also counts unmatched rows."""
    counts = route_camera(df).agg(
        *[F.count_if(F.col("camera_class") == name).alias(name) for name in CAMERA_CLASSES],
        F.count("*").alias("total"))
    pairs = F.array(*[F.struct(F.lit(n).alias("camera_class"), F.col(n).alias("messages"))
                      for n in [*CAMERA_CLASSES, "total"]])
    return counts.select(F.inline(pairs))


def camera_fields(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one class with its shown fields, defaults filled in."""
    body = F.col("_body")
    shown = [F.coalesce(body[field], F.lit(default)).alias(field) for field, default in SHOWN_FIELDS[name].items()]
    return (_of_class(df, name)
            .withColumn("_body", F.from_json("payload", CAMERA_SCHEMAS[name]))
            .select(*keep, "zone", "camera_id", *shown))


def camera_messages(df: DataFrame, name: str) -> DataFrame:
    """Rows of one class with all fields of its message, nested ones included, as one struct."""
    return (_of_class(df, name)
            .withColumn("message", F.from_json("payload", CAMERA_SCHEMAS[name])))


def camera_status(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return camera_fields(df, "status", keep)


def camera_motion(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return camera_fields(df, "motion", keep)


def camera_security(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return camera_fields(df, "security", keep)


def camera_system(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return camera_fields(df, "system", keep)


def camera_stream(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return camera_fields(df, "stream", keep)
