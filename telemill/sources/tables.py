"""Tables handed from stage to stage: canonical rows, features, alerts, attack logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from telemill.functions.times import parse_ts
from telemill.schemas import ALERT_COLUMNS, ALERTS_SCHEMA, ATTACK_LOG_SCHEMAS, FEATURES_SCHEMA

# CSV of others: records may span lines, blanks belong to their cells, columns go by the header.
READ_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False,
                "ignoreTrailingWhiteSpace": False, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# CSV of our own: a noncharacter stands for null, so that the empty text stays what it is.
CSV_OPTIONS = READ_OPTIONS | {"nullValue": "\ufdd0", "emptyValue": ""}
CANONICAL_KINDS = {"qos": "BIGINT", "retain": "BIGINT", "dupflag": "BIGINT", "payload_length": "BIGINT", "msgid": "BIGINT"}


def read_own_csv(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """A CSV table written here; columns by its header, typed by ``kinds``, else text."""
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    return spark.read.schema(_ddl(names, kinds)).options(**CSV_OPTIONS).csv(path)


def _ddl(names: list[str], kinds: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kinds.get(name, 'STRING')}" for name in names)


def _kinds(ddl: str) -> dict[str, str]:
    return dict(part.strip().split(" ") for part in ddl.split(","))


def write_table(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> int:
    """Write a table and return its row count, observed during the write."""
    rows = Observation()
    writer = df.observe(rows, F.count(F.lit(1)).alias("rows")).write.format(file_format).mode(mode)
    if file_format == "csv":
        writer = writer.options(**CSV_OPTIONS | {"emptyValue": '""'})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return rows.get["rows"]


def write_canonical(df: DataFrame, path: str, force: bool = False, file_format: str = "parquet") -> int:
    """Write canonical rows; an existing table is replaced only with ``force``."""
    return write_table(df, path, file_format, "overwrite" if force else "errorifexists")


def read_canonical(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    if file_format == "csv":
        return read_own_csv(spark, path, CANONICAL_KINDS)
    return spark.read.format(file_format).load(path)


def scan_mqtt(canonical: DataFrame) -> DataFrame:
    """Rows whose protocol mentions MQTT in any case; rows without a protocol are out."""
    return canonical.where(F.contains(F.upper("protocol"), F.lit("MQTT")))


def features_path(source: str) -> str:
    """Default name for the features of a table: ``features_<name without processed_>``."""
    folder, _, name = source.rstrip("/").rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return (folder + "/" if folder else "") + "features_" + stem.removeprefix("processed_")


def write_features(df: DataFrame, path: str, force: bool = False, file_format: str = "parquet") -> int:
    return write_table(df, path, file_format, "overwrite" if force else "errorifexists")


def read_features(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    if file_format == "csv":
        return read_own_csv(spark, path, _kinds(FEATURES_SCHEMA))
    return spark.read.format(file_format).load(path)


def write_alerts(alerts: DataFrame, path: str, file_format: str = "csv") -> int:
    """Append alerts; every CSV file carries the header and quotes what needs quoting."""
    return write_table(alerts.select(*ALERT_COLUMNS), path, file_format, "append")


def read_alerts(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    if file_format == "csv":
        return read_own_csv(spark, path, _kinds(ALERTS_SCHEMA))
    return spark.read.format(file_format).load(path)


def with_log_ts(df: DataFrame) -> DataFrame:
    """Add ``ts`` from whichever time column an attack log has."""
    name = "timestamp" if "timestamp" in df.columns else "timestamp_utc"
    return df.withColumn("ts", parse_ts(F.col(name)))


def read_attack_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the nine attack logs, with its time column as ``ts``."""
    if kind not in ATTACK_LOG_SCHEMAS:
        raise ValueError(f"unknown attack log {kind!r}, expected one of {sorted(ATTACK_LOG_SCHEMAS)}")
    kinds = _kinds(ATTACK_LOG_SCHEMAS[kind])
    names = spark.read.options(**READ_OPTIONS).csv(path).columns
    # columns by header, in whatever order; those that the file lacks are null
    found = spark.read.schema(_ddl(names, kinds)).options(**READ_OPTIONS).csv(path)
    missing = {name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in names}
    return with_log_ts(found.withColumns(missing).select(*kinds))
