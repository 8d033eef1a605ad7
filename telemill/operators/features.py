"""Per-message features of a traffic table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.numbers import to_number
from telemill.functions.payload import with_extracted_value
from telemill.functions.text import strip
from telemill.functions.times import epoch_seconds, parse_ts
from telemill.operators.ordered import Order, previous_ts
from telemill.schemas import TRUE_WORDS

FEATURE_COLUMNS = [
    "timestamp", "ts", "client_id", "topic", "value", "payload_length", "qos", "retain_flag", "dup_flag",
    "msgid_present", "iat_sec",
]


def resolve_column(df: DataFrame, *candidates: str) -> str | None:
    """First candidate present, by exact name or else regardless of case."""
    by_lower = {name.lower(): name for name in df.columns}
    for candidate in candidates:
        if candidate in df.columns:
            return candidate
        if candidate.lower() in by_lower:
            return by_lower[candidate.lower()]
    return None


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def feature_ts(df: DataFrame, now: Column | None = None) -> Column:
    """Timestamp per row. With ``now``, a column without any readable timestamp gets it throughout."""
    name = resolve_column(df, "timestamp", "ts", "time")
    if name is None:
        raise ValueError("no timestamp-like column")
    value = _col(name)
    kind = dict(df.dtypes)[name]
    ts = value.cast("timestamp") if kind.startswith("timestamp") else parse_ts(value)
    if now is None:
        return ts
    readable = df.agg(F.count(ts)).scalar()
    return F.coalesce(ts, F.when(readable == 0, now))


def feature_client_id(df: DataFrame) -> Column:
    client = "client_id" if "client_id" in df.columns else resolve_column(df, "clientid")
    address = resolve_column(df, "src_ip", "ip.src")
    names = [_col(name).cast("string") for name in (client, address) if name]
    return F.coalesce(*names, F.lit("unknown"))


def payload_source(df: DataFrame) -> tuple[str | None, bool]:
    """The column that holds the payload, and whether it has to be parsed."""
    payload = resolve_column(df, "payload") or resolve_column(df, "payload_sample")
    return (payload, True) if payload else (resolve_column(df, "value"), False)


def feature_payload_length(df: DataFrame, prefer: str = "payload") -> Column:
    """Length of the payload text; the stated length counts only without one (or if preferred)."""
    source, _ = payload_source(df)
    stated = resolve_column(df, "payload_length")
    if source and not (stated and prefer == "payload_length"):
        return F.length(F.coalesce(_col(source).cast("string"), F.lit("")))
    if stated:
        return F.coalesce(to_number(_col(stated)).try_cast("int"), F.lit(0))
    return F.lit(0)


def feature_qos(df: DataFrame) -> Column:
    name = resolve_column(df, "qos")
    return F.lit(0) if name is None else F.coalesce(to_number(_col(name)).try_cast("int"), F.lit(0))


def flag(value: Column) -> Column:
    """1 for a number whose whole part is not zero or for a word meaning true; else 0."""
    text = F.lower(strip(value.cast("string")))
    number = to_number(text)
    on = F.when(number.isNotNull(), F.abs(number) >= 1).otherwise(text.isin(TRUE_WORDS))
    return F.coalesce(on, F.lit(False)).cast("int")


def feature_flag(df: DataFrame, *candidates: str) -> Column:
    name = resolve_column(df, *candidates)
    return F.lit(0) if name is None else flag(_col(name))


def msgid_present(df: DataFrame) -> Column:
    name = resolve_column(df, "msgid")
    return F.lit(0) if name is None else _col(name).isNotNull().cast("int")


def inter_arrival(df: DataFrame, order: Order, name: str = "iat_sec") -> DataFrame:
    """Seconds since the previous row of the same key; 0.0 for the first row and without a timestamp."""
    gap = (F.unix_micros(order.ts) - F.unix_micros("_previous")) / 1_000_000
    return (previous_ts(df, order, "_previous")
            .withColumn(name, F.coalesce(gap, F.lit(0.0)))
            .drop("_previous"))


def sort_by_time(df: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(seq).asc())


def message_fields(df: DataFrame, seq: str | None = "seq", prefer: str = "payload",
                   now: Column | None = None) -> DataFrame:
    """The row-wise features: one projection, no shuffle, usable on a stream too.

    Without a ``seq`` column a hash of the whole row breaks ties, so only identical rows stay unordered.
    """
    source, parsed = payload_source(df)
    topic = resolve_column(df, "topic")
    label = resolve_column(df, "Label")
    tie_break = _col(seq) if seq else F.xxhash64(*[_col(c) for c in df.columns])
    payload = F.lit(None).cast("string") if source is None else _col(source).cast("string")
    fields = {
        "ts": feature_ts(df, now),
        "client_id": feature_client_id(df),
        **({"topic": _col(topic)} if topic else {}),
        "_payload": payload,
        "payload_length": feature_payload_length(df, prefer),
        "qos": feature_qos(df),
        "retain_flag": feature_flag(df, "retain", "retain_flag"),
        "dup_flag": feature_flag(df, "dupflag", "dup_flag"),
        "msgid_present": msgid_present(df),
        **({"Label": _col(label)} if label else {}),
        "seq": tie_break,
    }
    out = df.select(*[column.alias(name) for name, column in fields.items()])
    if parsed:
        out = with_extracted_value(out, F.col("_payload"))
    else:
        out = out.withColumn("value", F.col("_payload")).withColumn("value_num", to_number(F.col("_payload")))
    return out.withColumn("timestamp", epoch_seconds(F.col("ts"))).drop("_payload")


def extract_features(df: DataFrame, seq: str | None = "seq", prefer: str = "payload", now: Column | None = None,
                     **order_options) -> DataFrame:
    """Feature rows: one projection, then the inter-arrival time per client."""
    rows = message_fields(df, seq, prefer, now)
    timed = inter_arrival(rows, Order(("client_id",), **order_options))
    extra = [name for name in ("Label", "value_num", "seq") if name in timed.columns]
    return timed.select(*[name for name in FEATURE_COLUMNS if name in timed.columns], *extra)
