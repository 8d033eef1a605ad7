"""What every operator of this package needs from the session: its code on the executors, tables, scratch folders."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile

import telemill
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.session import scratch_path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session; Spark itself hands the file out."""
    context = spark.sparkContext
    if getattr(context, "_telemill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(telemill.__file__))
    if not os.path.isdir(root):  # already imported from such an archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="telemill-code-"), "telemill_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("telemill", os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._telemill_shipped = True


_held: dict = {}


def held(key, make):
    """What a worker keeps for its later tasks. One thing at a time: a stage that holds another, or none, drops it."""
    if key not in _held:
        drop_held()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    """Give back what an earlier stage has left in this worker."""
    if _held:
        import pyarrow as pa

        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    kept = spark.read.schema(frame.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete what ``keep`` has written, once nothing will read it again."""
    context = kept.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, whose results are stored: it does once nothing refers to them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def spare_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_texts(docs: DataFrame, text_col: str, prepare) -> DataFrame:
    """The rows whose texts pass, all columns as they are; one narrow pass.

    ``prepare()`` is called once a task and gives ``decide(bytes, offsets)``, which is true for texts that stay.
    """
    from telemill.llm.words import blocks
    import pyarrow as pa

    ship(docs.sparkSession)
    name = spare_name(docs, "text_bytes")

    def run(batches):
        decide = prepare()
        for rows, data, offsets in blocks(batches, name):
            yield rows.select(rows.schema.names[:-1]).filter(pa.array(decide(data, offsets)))

    return docs.withColumn(name, F.col(text_col).cast("binary")).mapInArrow(run, docs.schema)
