"""Raw tables of any header style to the canonical table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from telemill.functions.numbers import numeric_field, to_number
from telemill.functions.text import (
    bool_flag, decode_hex_payload, hex_length, not_empty, sanitize_text, string_field,
)
from telemill.functions.times import format_ts, parse_ts
from telemill.schemas import (
    CANONICAL_COLUMNS, DEFAULT_PROTOCOLS, FIELD_ALIASES, PACKET_NAMES, PAYLOAD_LENGTH_PRIORITY,
    PAYLOAD_SAMPLE_PRIORITY,
)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[name.strip() for name in df.columns])


def allowed_protocols(names: str = DEFAULT_PROTOCOLS) -> list[str]:
    allowed = list(dict.fromkeys(p.strip().upper() for p in names.split(",") if p.strip()))
    if not allowed:
        raise ValueError("no allowed protocols configured")
    return allowed


class RawFields:
    """The columns of one raw table by header name.

    Columns are addressed by position, so names with dots, or names that differ only in case, need
    no session setting.
    """

    def __init__(self, df: DataFrame):
        self.headers = [name.strip() for name in df.columns]
        self.frame = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
        self._positions = {}
        for position, name in enumerate(self.headers):
            self._positions.setdefault(name, f"_{position}")

    def column(self, name: str) -> Column | None:
        position = self._positions.get(name)
        return None if position is None else F.col(position)

    def pick(self, field: str) -> Column | None:
        """Column of the first alias present; case-sensitive."""
        for alias in FIELD_ALIASES[field]:
            if alias in self._positions:
                return self.column(alias)
        return None

    @property
    def looks_like_mqtt(self) -> bool:
        return any(name.lower().startswith("mqtt") for name in self.headers)


def protocol(fields: RawFields) -> Column:
    """Upper-case protocol; unknown becomes MQTT when any header starts with ``mqtt``."""
    unknown = F.lit("MQTT" if fields.looks_like_mqtt else "UNKNOWN")
    named = F.upper(string_field(fields.pick("protocol")))
    return F.when(named.isin("", "UNKNOWN"), unknown).otherwise(named)


def payload_length(fields: RawFields) -> Column:
    """Length from the first column present, whatever its values are."""
    stated = fields.pick("payload_length")
    if stated is not None:
        return numeric_field(stated, default=None)
    for name, kind in PAYLOAD_LENGTH_PRIORITY:
        value = fields.column(name)
        if value is None:
            continue
        if kind == "hex":
            return hex_length(value.cast("string"))
        if kind == "text":
            return F.length(F.coalesce(value.cast("string"), F.lit(""))).cast("bigint")
        return numeric_field(value, default=None)
    return F.lit(None).cast("bigint")


def payload_sample(fields: RawFields) -> Column:
    """First readable text over the payload columns, row by row."""
    readable = []
    for name, hex_encoded in PAYLOAD_SAMPLE_PRIORITY:
        value = fields.column(name)
        if value is not None:
            clean = decode_hex_payload if hex_encoded else sanitize_text
            readable.append(not_empty(clean(value.cast("string"))))
    return F.coalesce(*readable, F.lit(""))


def packet_type(value: Column | None) -> Column:
    """Control packet name for numbers 1 to 15, else the upper-case text."""
    if value is None:
        return F.lit("UNKNOWN")
    text = string_field(value)
    names = F.create_map(*[F.lit(item) for n, name in enumerate(PACKET_NAMES, 1) for item in (float(n), name)])
    return F.coalesce(F.try_element_at(names, to_number(text)), not_empty(F.upper(text)), F.lit("UNKNOWN"))


def client_id(fields: RawFields) -> Column:
    """Client, else source address, else ``unknown``."""
    return F.coalesce(
        not_empty(string_field(fields.pick("client_id"))),
        not_empty(string_field(fields.pick("src_ip"))),
        F.lit("unknown"))


def label(value: Column | None) -> Column:
    return F.coalesce(not_empty(string_field(value)), F.lit("unknown"))


def canonical_projection(fields: RawFields) -> dict[str, Column]:
    stamp = fields.pick("timestamp")
    ts = F.lit(None).cast("timestamp") if stamp is None else parse_ts(stamp)
    plain = ["src_ip", "src_port", "dst_ip", "dst_port", "topic", "topicfilter", "connack_code",
             "username", "auth_reason"]
    columns = {name: string_field(fields.pick(name)) for name in plain}
    columns.update({
        "timestamp": format_ts(ts),
        "client_id": client_id(fields),
        "qos": numeric_field(fields.pick("qos")),
        "retain": bool_flag(fields.pick("retain")),
        "dupflag": bool_flag(fields.pick("dupflag")),
        "payload_length": payload_length(fields),
        "Payload_sample": payload_sample(fields),
        "packet_type": packet_type(fields.pick("packet_type")),
        "protocol": protocol(fields),
        "Label": label(fields.pick("Label")),
        "msgid": numeric_field(fields.pick("msgid"), default=None),
    })
    return columns


def canonicalize(df: DataFrame, protocols: list[str] | None = None, keep: list[str] | None = None,
                 rejects: Observation | None = None) -> DataFrame:
    """One raw table to the 20 canonical columns; rows need a timestamp and an allowed protocol.

    A single projection and filter: nothing is shuffled. ``keep`` names raw columns to pass through
    (a sequence number, say). ``rejects`` observes ``rows``, ``no_timestamp`` and ``protocol`` (another protocol, with a
    timestamp) in the same pass; filters on the result don't reach the scan then, for every row is counted.
    """
    fields = RawFields(df)
    columns = canonical_projection(fields)
    passed = [fields.column(name).alias(name) for name in keep or []]
    allowed = allowed_protocols() if protocols is None else protocols
    stamped, named = F.col("timestamp") != "", F.col("protocol").isin(allowed)
    rows = fields.frame.select(*[columns[name].alias(name) for name in CANONICAL_COLUMNS], *passed)
    if rejects is not None:
        rows = rows.observe(rejects, F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(stamped, F.lit(False))).alias("no_timestamp"),
                            F.count_if(stamped & ~F.coalesce(named, F.lit(False))).alias("protocol"))
    return rows.where(stamped & named)


def canonicalize_files(frames: list[DataFrame], protocols: list[str] | None = None,
                       rejects: list[Observation] | None = None) -> DataFrame:
    """Canonical rows of several raw tables, each resolved by its own header; ``rejects`` gets an observation per table."""
    if not frames:
        raise ValueError("no input tables")
    observed = [None] * len(frames) if rejects is None else [Observation() for _ in frames]
    if rejects is not None:
        rejects += observed
    return reduce(DataFrame.unionByName, [canonicalize(f, protocols, rejects=o) for f, o in zip(frames, observed)])
