"""Queries for the field functions and canonicalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions import numbers, text, times
from telemill.operators import canonical
from telemill.plans.registry import query
from telemill.plans.traffic import Tables
from telemill.schemas import CANONICAL_COLUMNS, PACKET_NAMES
from telemill.session import scratch_path
from telemill.sources import raw, tables


def sanitized(value: str) -> str:
    printable = f"regexp_replace({value}, '[^\\x20-\\x7E]+', '', 'g')"
    return f"substr(trim(regexp_replace({printable}, ' {{2,}}', ' ', 'g')), 1, 120)"


def hex_digits(value: str) -> str:
    return f"replace(replace({value}, ':', ''), ' ', '')"


def is_hex(value: str) -> str:
    return f"regexp_matches({hex_digits(value)}, '^[0-9a-fA-F]+$')"


def hex_length(value: str) -> str:
    return f"CASE WHEN {is_hex(value)} THEN length({hex_digits(value)}) // 2 ELSE length({value}) END"


MIXED_TIME = {
    "spark": "CASE WHEN seq % 2 = 0 THEN ts_text ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") END",
}


@query("parse_ts", """
    SELECT seq, CASE WHEN ts IS NULL THEN NULL
      WHEN seq % 2 = 0 THEN CAST(round(CAST(ts_text AS DOUBLE) * 1000000) AS BIGINT)
      ELSE epoch_us(ts) END AS ts_us FROM traffic""", "traffic")
def parse_ts(t: Tables) -> DataFrame:
    written = F.expr(MIXED_TIME["spark"])
    return t.traffic.select("seq", F.unix_micros(times.parse_ts(written)).alias("ts_us"))


@query("format_ts", """
    SELECT seq, coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS "timestamp" FROM traffic""", "traffic")
def format_ts(t: Tables) -> DataFrame:
    return t.traffic.select("seq", times.format_ts(F.col("ts")).alias("timestamp"))


@query("string_field", """
    SELECT seq, coalesce(topic, '') AS topic, 'none' AS absent FROM traffic""", "traffic")
def string_field(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" \t"), "topic", F.lit(" \n"))
    return t.traffic.select("seq", text.string_field(padded).alias("topic"), text.string_field(None, "none").alias("absent"))


@query("bool_flag", """
    SELECT seq, CAST(CASE WHEN seq % 8 < 4 THEN 1 ELSE 0 END AS BIGINT) AS flag FROM traffic""", "traffic")
def bool_flag(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("True", " 1", "YES ", "t", "0", "1.0", "2")])
    return t.traffic.select("seq", text.bool_flag(F.get(words, F.col("seq") % 8)).alias("flag"))


@query("numeric_field", """
    SELECT seq, CAST(coalesce(n, 0) AS BIGINT) AS with_default, CAST(n AS BIGINT) AS nullable FROM (
      SELECT seq, CASE seq % 8 WHEN 0 THEN seq WHEN 1 THEN 3 WHEN 2 THEN 200 WHEN 3 THEN -4 END AS n FROM traffic)
    """, "traffic")
def numeric_field(t: Tables) -> DataFrame:
    words = F.array(F.col("seq").cast("string"), *[F.lit(w) for w in ("3.0", " 2e2 ", "-4", "1.5", "1.5d", "x")])
    written = F.get(words, F.col("seq") % 8)
    return t.traffic.select("seq", numbers.numeric_field(written).alias("with_default"),
                            numbers.numeric_field(written, default=None).alias("nullable"))


@query("protocol", """
    SELECT seq, CASE WHEN seq % 5 = 0 THEN 'MQTT' ELSE upper(protocol) END AS under_mqtt_headers,
      CASE WHEN seq % 5 = 0 THEN 'UNKNOWN' ELSE upper(protocol) END AS under_plain_headers FROM traffic""", "traffic")
def protocol(t: Tables) -> DataFrame:
    written = F.when(F.col("seq") % 5 != 0, F.concat(F.lit(" "), "protocol"))
    capture = canonical.RawFields(t.traffic.select("seq", written.alias("mqtt.protoname")))
    plain = canonical.RawFields(t.traffic.select("seq", written.alias("protocol")))
    return capture.frame.select(
        capture.column("seq").alias("seq"), canonical.protocol(capture).alias("under_mqtt_headers"),
        canonical.protocol(plain).alias("under_plain_headers"))


@query("sanitize_text", f"SELECT doc_id, {sanitized('text')} AS sample FROM documents")
def sanitize_text(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", text.sanitize_text(F.col("text")).alias("sample"))


def _encoded_text(t: Tables) -> DataFrame:
    """Documents as payloads: hex, hex after a byte that is no UTF-8, or plain text."""
    in_hex = F.hex(F.encode("text", "UTF-8"))
    written = F.when(F.col("doc_id") % 3 == 0, in_hex).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("ff:"), F.lower(in_hex))).otherwise(F.col("text"))
    return t.table("documents").select("doc_id", written.alias("payload"))


ENCODED = """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN hex(text) WHEN 1 THEN 'ff:' || lower(hex(text)) ELSE text END AS payload,
      text FROM documents"""


@query("decode_hex_payload", f"""
    WITH encoded AS ({ENCODED}),
    split AS (SELECT doc_id, payload, {is_hex('payload')} AS in_hex,
      CASE WHEN {is_hex('payload')} THEN regexp_extract_all(lower({hex_digits('payload')}), '..') ELSE [] END AS bytes
      FROM encoded),
    readable AS (SELECT doc_id, payload, in_hex, bytes, array_to_string(list_transform(
      list_filter(bytes, lambda b: b >= '20' AND b <= '7e'), lambda b: chr(CAST('0x' || b AS INTEGER))), '') AS chars
      FROM split)
    SELECT doc_id, CASE WHEN NOT in_hex THEN {sanitized("trim(payload, chr(9) || chr(10) || ' ')")}
      WHEN {sanitized('chars')} <> '' THEN {sanitized('chars')}
      ELSE array_to_string(bytes[1:120], '') END AS sample FROM readable""")
def decode_hex_payload(t: Tables) -> DataFrame:
    return _encoded_text(t).select("doc_id", text.decode_hex_payload(F.col("payload")).alias("sample"))


@query("hex_length", f"""
    WITH encoded AS ({ENCODED}), trimmed AS (
      SELECT doc_id, trim(payload, chr(9) || chr(10) || chr(13) || chr(160) || ' ') AS payload FROM encoded)
    SELECT doc_id, CAST({hex_length('payload')} AS BIGINT) AS bytes FROM trimmed""")
def hex_length_query(t: Tables) -> DataFrame:
    return _encoded_text(t).select("doc_id", text.hex_length(F.col("payload")).alias("bytes"))


@query("payload_length", f"""
    SELECT seq, CAST({hex_length('"mqtt.msg"')} AS BIGINT) AS from_message,
      CAST(CASE WHEN seq % 2 = 0 THEN seq END AS BIGINT) AS from_stated FROM capture""", "capture")
def payload_length(t: Tables) -> DataFrame:
    view = t.view("capture")
    message = canonical.RawFields(view)
    stated = canonical.RawFields(view.withColumn(
        "mqtt.msg_len", F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string")).otherwise(F.lit("1.5"))))
    return stated.frame.select(
        "_0", canonical.payload_length(message).alias("from_message"),
        canonical.payload_length(stated).alias("from_stated")).withColumnRenamed("_0", "seq")


@query("payload_sample", f"""
    SELECT seq, CASE WHEN seq % 4 = 1 AND {sanitized('topic')} <> '' THEN {sanitized('topic')}
      ELSE {sanitized('payload')} END AS sample
    FROM (SELECT seq, coalesce(topic, '') AS topic, payload FROM traffic)""", "traffic")
def payload_sample(t: Tables) -> DataFrame:
    """Rows whose first payload column is missing, blank or unreadable fall through to the hex message."""
    first = F.when(F.col("seq") % 4 == 1, F.col("topic")).when(F.col("seq") % 4 == 2, F.lit("\t "))
    fields = canonical.RawFields(t.traffic.select(
        "seq", first.alias("payload_sample"), F.hex("payload").alias("mqtt.msg")))
    return fields.frame.select(fields.column("seq").alias("seq"), canonical.payload_sample(fields).alias("sample"))


NAMES = "[" + ", ".join(f"'{n}'" for n in PACKET_NAMES) + "]"


def packet_name(code: str) -> str:
    return (f"CASE WHEN CAST({code} AS INTEGER) BETWEEN 1 AND 15 THEN ({NAMES})[CAST({code} AS INTEGER)] "
            f"ELSE {code} END")


@query("packet_type", f"""
    SELECT seq, CASE seq % 4 WHEN 2 THEN 'PUBLISH' WHEN 3 THEN 'UNKNOWN'
      ELSE CASE WHEN seq % 4 = 1 AND CAST(packet_code AS INTEGER) NOT BETWEEN 1 AND 15 THEN packet_code || '.0'
        ELSE {packet_name('packet_code')} END END AS packet_type FROM traffic""", "traffic")
def packet_type(t: Tables) -> DataFrame:
    written = F.expr("CASE seq % 4 WHEN 0 THEN packet_code WHEN 1 THEN packet_code || '.0' WHEN 2 THEN ' publish' END")
    return t.traffic.select("seq", canonical.packet_type(written).alias("packet_type"))


@query("client_id", """
    SELECT seq, CASE WHEN seq % 3 = 0 THEN client_id WHEN seq % 3 = 1 THEN src_ip ELSE 'unknown' END AS client_id
    FROM traffic""", "traffic")
def client_id(t: Tables) -> DataFrame:
    fields = canonical.RawFields(t.traffic.select(
        "seq", F.when(F.col("seq") % 3 == 0, F.col("client_id")).alias("mqtt.clientid"),
        F.when(F.col("seq") % 3 == 1, F.col("src_ip")).otherwise(F.lit(" ")).alias("ip.src")))
    return fields.frame.select(fields.column("seq").alias("seq"), canonical.client_id(fields).alias("client_id"))


@query("label", """
    SELECT seq, coalesce(nullif(label, ''), 'unknown') AS "Label" FROM traffic""", "traffic")
def label(t: Tables) -> DataFrame:
    return t.traffic.select("seq", canonical.label(F.col("label")).alias("Label"))


def canonical_sql(view: str, extra: str = "") -> str:
    """The canonical rows of one of the two raw views."""
    shared = f"""{extra}strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp", src_ip,
      CAST(qos AS BIGINT) AS qos, CAST(retain AS BIGINT) AS retain, coalesce(topic, '') AS topic, '' AS topicfilter,
      '10.1.0.1' AS dst_ip, '1883' AS dst_port, upper(protocol) AS protocol,
      coalesce(nullif(label, ''), 'unknown') AS "Label", '' AS connack_code, '' AS username, '' AS auth_reason,
      {sanitized('payload')} AS "Payload_sample" """
    message = "CASE WHEN seq % 9 = 0 THEN payload ELSE lower(hex(payload)) END"
    own = {
        "capture": f"""CAST(40000 + user_id % 1000 AS VARCHAR) AS src_port,
          CASE WHEN seq % 11 <> 0 THEN client_id ELSE src_ip END AS client_id, CAST(dupflag AS BIGINT) AS dupflag,
          CAST({hex_length(message)} AS BIGINT) AS payload_length, {packet_name('packet_code')} AS packet_type,
          CAST(msgid AS BIGINT) AS msgid""",
        "plain": """'50000' AS src_port, client_id, CAST(0 AS BIGINT) AS dupflag,
          CAST(length(payload) AS BIGINT) AS payload_length, packet_type, CAST(NULL AS BIGINT) AS msgid""",
    }[view]
    return f"SELECT {shared}, {own} FROM traffic WHERE ts IS NOT NULL AND protocol <> 'ftp'"


@query("canonicalize", canonical_sql("capture", "seq, "), "traffic")
def canonicalize(t: Tables) -> DataFrame:
    return canonical.canonicalize(t.view("capture"), keep=["seq"])


def _raw_files(t: Tables) -> str:
    """Both raw styles exported as CSV below one folder; the export grows with the tables."""
    folder = scratch_path(t.spark, "raw")
    for name in ("capture", "plain"):
        t.view(name).drop("seq").write.csv(f"{folder}/{name}.csv", header=True, quote='"', escape='"')
    return folder


@query("scan_raw", """
    SELECT 16 AS columns, count(*) AS "rows", count("mqtt.topic") AS with_topic FROM capture
    UNION ALL SELECT 13, count(*), count(topic) FROM plain""", "capture", "plain")
def scan_raw(t: Tables) -> DataFrame:
    folder = _raw_files(t)
    frames = raw.scan_raw(t.spark, [f"{folder}/capture.csv", f"{folder}/plain.csv"])
    counts = []
    for frame in frames:
        topic = "`mqtt.topic`" if "mqtt.topic" in frame.columns else "topic"
        counts.append(frame.agg(F.lit(len(frame.columns)).alias("columns"), F.count("*").alias("rows"),
                                F.count(topic).alias("with_topic")))
    return counts[0].unionByName(counts[1])


CSV_CANONICAL = canonical_sql("capture") + " UNION ALL BY NAME " + canonical_sql("plain")


@query("canonicalize_files", CSV_CANONICAL, "traffic")
def canonicalize_files(t: Tables) -> DataFrame:
    folder = _raw_files(t)
    return raw.canonicalize_inputs(t.spark, [f"{folder}/capture.csv", f"{folder}/plain.csv"])


@query("write_canonical", canonical_sql("capture"), "traffic")
def write_canonical(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "canonical")
    tables.write_canonical(canonical.canonicalize(t.view("capture")), path)
    return tables.read_canonical(t.spark, path).select(*CANONICAL_COLUMNS)


@query("write_canonical_csv", canonical_sql("capture"), "traffic")
def write_canonical_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "canonical-csv")
    tables.write_canonical(canonical.canonicalize(t.view("capture")), path, file_format="csv")
    return tables.read_canonical(t.spark, path, "csv").select(*CANONICAL_COLUMNS)


@query("scan_mqtt", """
    SELECT protocol, count(*) AS "rows" FROM traffic WHERE protocol = 'mqtt' GROUP BY protocol""", "traffic")
def scan_mqtt(t: Tables) -> DataFrame:
    return tables.scan_mqtt(t.traffic).groupBy("protocol").agg(F.count("*").alias("rows"))
