"""Time canonicalisation, features and detection on enlarged traffic.

``SCALE_FACTOR`` copies of the sf0.1 events (shifted in time, with their own ids) are written below the shared folder
first; every stage then reads the table the stage before it wrote.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators import canonical, detection, features, windows
from telemill.plans.traffic import Tables
from telemill.session import scratch_path
from telemill.sources import tables


def enlarged(t: Tables, copies: int) -> DataFrame:
    """Events repeated; a third of all rows stays with one client of the traffic view."""
    each = t.table("events").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rows = t.table("events").agg(F.count("*")).scalar()
    return each.select(
        (F.col("event_id") + F.col("_copy") * rows).alias("event_id"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("_copy") * 7)).alias("ts"),
        (F.col("user_id") + F.col("_copy") * 1500).alias("user_id"), "event_type", "value", "props")


def main() -> None:
    copies, cpus = int(os.environ.get("SCALE_FACTOR", "40")), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "32").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="telemill-"))  # one machine
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    t = Tables(spark, "/root/testdata/sf0.1")
    folder = scratch_path(spark, "scale")
    seconds = {}

    def timed(name: str, make) -> DataFrame:
        started, path = time.perf_counter(), f"{folder}/{name}"
        rows = tables.write_table(make(), path)
        seconds[name] = {"sec": round(time.perf_counter() - started, 1), "rows": rows}
        print(name, seconds[name], flush=True)
        return spark.read.parquet(path)

    events = timed("events", lambda: enlarged(t, copies).repartition(16))
    capture = timed("capture", lambda: t.view("capture", events))
    made = timed("canonical", lambda: canonical.canonicalize(capture, keep=["seq"]))
    featured = timed("features", lambda: features.extract_features(made))
    timed("alerts", lambda: detection.detect(featured))
    timed("alerts_small_slices", lambda: detection.detect(featured, max_rows=20000))
    timed("windowed", lambda: windows.detect_windowed(featured))
    print(json.dumps({"cores": cpus, "spark": spark.version, "stages": seconds}))


if __name__ == "__main__":
    main()
