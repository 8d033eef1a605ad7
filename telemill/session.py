"""Session settings and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Semantics every operator relies on; all of them are runtime settings.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # up to so many rows per key, Spark keeps the first ones of a ranking before it shuffles
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # HotSpot does not compile methods above this size; wide projections run faster split into small ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    ``spark.checkpoint.dir`` where it is set, else a folder below ``spark.sql.warehouse.dir``, which Spark expects to
    be shared. On a cluster a warehouse path without the scheme of a shared file system is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = warehouse.partition(":")[0] if ":" in warehouse else "file"
    if scheme == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; "
                         f"the warehouse {warehouse!r} is on the driver's own disk")
    return f"{warehouse}/telemill-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path in the shared folder."""
    return f"{shared_folder(spark)}/telemill-{name}-{uuid.uuid4().hex}"
