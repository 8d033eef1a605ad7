"""Checkpointed file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_to_table(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet",
                    available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """Append a stream to a file table, exactly once per checkpoint."""
    writer = (df.writeStream.format(file_format).outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    if file_format == "csv":
        writer = writer.option("header", True)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def run_to_end(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> None:
    """Process everything there is now, then stop."""
    append_to_table(df, path, checkpoint, file_format, available_now=True).awaitTermination()
