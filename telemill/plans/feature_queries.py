"""Queries for features, message collection, topics and devices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions import payload as payloads
from telemill.functions import text, times, topics
from telemill.operators import devices, features, messages, subscriptions
from telemill.operators.ordered import Order
from telemill.plans.registry import query
from telemill.plans.traffic import Tables
from telemill.schemas import DEVICE_PATTERNS
from telemill.session import scratch_path
from telemill.sources import tables

# --- pieces of the check SQL ---
VALUE = """CASE WHEN payload LIKE '{{%' THEN coalesce(json_extract_string(payload, '$.value'),
  json_extract_string(payload, '$.temp'), json_extract_string(payload, '$.k'), json_extract_string(payload, '$.flag'))
  ELSE CAST(TRY_CAST(payload AS DOUBLE) AS VARCHAR) END""".replace("{{", "{")
GAP = """coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (
  PARTITION BY client_id ORDER BY ts NULLS LAST, seq))) / 1000000, 0.0)"""
FEATURES = f"""
  SELECT coalesce(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT), 0) AS "timestamp", epoch_us(ts) AS ts_us, client_id,
    topic, {VALUE} AS value, CASE {VALUE} WHEN 'true' THEN 1.0 ELSE TRY_CAST({VALUE} AS DOUBLE) END AS value_num,
    CAST(length(payload) AS INTEGER) AS payload_length, qos, retain AS retain_flag, dupflag AS dup_flag,
    CAST(CASE WHEN msgid IS NULL THEN 0 ELSE 1 END AS INTEGER) AS msgid_present, round({GAP}, 6) AS iat_sec,
    label AS "Label", seq FROM traffic"""


@query("feature_ts", """
    SELECT seq, coalesce(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT), 0) AS "timestamp", epoch_us(ts) AS ts_us
    FROM traffic""", "traffic")
def feature_ts(t: Tables) -> DataFrame:
    written = t.traffic.select("seq", F.col("ts_text").alias("Timestamp"))
    ts = features.feature_ts(written, now=F.lit(0).cast("timestamp"))
    return written.withColumn("ts", ts).select(
        "seq", times.epoch_seconds(F.col("ts")).alias("timestamp"), F.unix_micros("ts").alias("ts_us"))


@query("feature_client_id", """
    SELECT seq, CASE WHEN seq % 5 = 0 THEN src_ip ELSE client_id END AS client_id FROM traffic""", "traffic")
def feature_client_id(t: Tables) -> DataFrame:
    rows = t.traffic.select("seq", F.when(F.col("seq") % 5 != 0, F.col("client_id")).alias("ClientID"), "src_ip")
    return rows.select("seq", features.feature_client_id(rows).alias("client_id"))


@query("extract_value", f"""
    SELECT seq, {VALUE} AS value, CASE {VALUE} WHEN 'true' THEN 1.0 ELSE TRY_CAST({VALUE} AS DOUBLE) END AS value_num
    FROM traffic""", "traffic")
def extract_value(t: Tables) -> DataFrame:
    rows = t.traffic.select("seq", "payload")
    return payloads.with_extracted_value(rows, F.col("payload")).select("seq", "value", "value_num")


@query("feature_payload_length", """
    SELECT seq, CAST(length(payload) AS INTEGER) AS payload_length, CAST(seq % 500 AS INTEGER) AS stated
    FROM traffic""", "traffic")
def feature_payload_length(t: Tables) -> DataFrame:
    rows = t.traffic.select("seq", "payload", (F.col("seq") % 500).cast("string").alias("payload_length"))
    return rows.select("seq", features.feature_payload_length(rows).alias("payload_length"),
                       features.feature_payload_length(rows, prefer="payload_length").alias("stated"))


@query("feature_qos", """
    SELECT seq, CAST(CASE WHEN seq % 4 = 0 THEN 0 ELSE qos END AS INTEGER) AS qos FROM traffic""", "traffic")
def feature_qos(t: Tables) -> DataFrame:
    rows = t.traffic.select("seq", F.when(F.col("seq") % 8 == 0, "high").when(
        F.col("seq") % 4 != 0, F.concat(F.col("qos").cast("string"), F.lit(".0"))).alias("QoS"))
    return rows.select("seq", features.feature_qos(rows).alias("qos"))


@query("flag", """
    SELECT seq, CAST(CASE WHEN seq % 8 < 4 THEN 1 ELSE 0 END AS INTEGER) AS flag, retain AS retain_flag,
      dupflag AS dup_flag FROM traffic""", "traffic")
def flag(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("True", " 1", "YES ", "-2.5", "0", "0.5", "on")])
    rows = t.traffic.select("seq", "retain", "dupflag", F.get(words, F.col("seq") % 8).alias("word"))
    return rows.select("seq", features.flag(F.col("word")).alias("flag"),
                       features.feature_flag(rows, "retain", "retain_flag").alias("retain_flag"),
                       features.feature_flag(rows, "dupflag", "dup_flag").alias("dup_flag"))


@query("msgid_present", """
    SELECT seq, CAST(CASE WHEN msgid IS NULL THEN 0 ELSE 1 END AS INTEGER) AS msgid_present FROM traffic""", "traffic")
def msgid_present(t: Tables) -> DataFrame:
    return t.traffic.select("seq", features.msgid_present(t.traffic).alias("msgid_present"))


@query("epoch_seconds", """
    SELECT seq, coalesce(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT), 0) AS "timestamp" FROM traffic""", "traffic")
def epoch_seconds(t: Tables) -> DataFrame:
    return t.traffic.select("seq", times.epoch_seconds(F.col("ts")).alias("timestamp"))


@query("inter_arrival", f"SELECT seq, client_id, round({GAP}, 6) AS iat_sec FROM traffic", "traffic")
def inter_arrival(t: Tables, max_rows: int = 100_000) -> DataFrame:
    rows = t.traffic.select("seq", "client_id", "ts")
    return features.inter_arrival(rows, Order(("client_id",), max_rows=max_rows)).select(
        "seq", "client_id", F.round("iat_sec", 6).alias("iat_sec"))


@query("inter_arrival_sliced", f"SELECT seq, client_id, round({GAP}, 6) AS iat_sec FROM traffic", "traffic")
def inter_arrival_sliced(t: Tables) -> DataFrame:
    """The same with dominant clients cut into slices."""
    return inter_arrival(t, max_rows=100)


@query("sort_by_time", "SELECT seq, epoch_us(ts) AS ts_us FROM traffic ORDER BY ts NULLS LAST, seq", "traffic")
def sort_by_time(t: Tables) -> DataFrame:
    return features.sort_by_time(t.traffic.select("seq", "ts")).select("seq", F.unix_micros("ts").alias("ts_us"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts_us", F.unix_micros("ts")).withColumn("iat_sec", F.round("iat_sec", 6)).drop("ts")


def _log_rows(t: Tables) -> DataFrame:
    return t.traffic.select("ts", "client_id", "src_ip", "topic", "payload", "qos", "retain", "dupflag", "msgid",
                            "label", "seq")


@query("extract_features", FEATURES, "traffic")
def extract_features(t: Tables) -> DataFrame:
    return _flat(features.extract_features(_log_rows(t)))


@query("read_features", FEATURES, "traffic")
def read_features(t: Tables) -> DataFrame:
    path = tables.features_path(scratch_path(t.spark, "processed_traffic"))
    tables.write_features(features.extract_features(_log_rows(t)), path, file_format="csv")
    return _flat(tables.read_features(t.spark, path, file_format="csv"))


# --- topics ---

FILTERS = [
    "site/canonical/+/device_001/telemetry", "site/canonical/click/#", "site/#", "#", "$SYS/#", "+/broker/+",
    "site/+/view/+/telemetry", "Door Lock", "+", "site/canonical/error/device_002/telemetry",
    "site/canonical/error/device_002/telemetry/#", "$SYS/broker/+",
]


# the same filters written by hand as patterns of the checking engine, and whether topics under $ are excluded
PATTERNS = [
    (r"(?s)\Asite/canonical/[^/]*/device_001/telemetry\z", False), (r"(?s)\Asite/canonical/click(/.*)?\z", False),
    (r"(?s)\Asite(/.*)?\z", False), (r"(?s)\A.*\z", True), (r"(?s)\A\$SYS(/.*)?\z", False),
    (r"(?s)\A[^/]*/broker/[^/]*\z", True), (r"(?s)\Asite/[^/]*/view/[^/]*/telemetry\z", False),
    (r"(?s)\ADoor Lock\z", False), (r"(?s)\A[^/]*\z", True),
    (r"(?s)\Asite/canonical/error/device_002/telemetry\z", False),
    (r"(?s)\Asite/canonical/error/device_002/telemetry(/.*)?\z", False), (r"(?s)\A\$SYS/broker/[^/]*\z", False),
]


def _filter_list() -> str:
    rows = ", ".join(f"('{name}', '{pattern}', {guarded})" for name, (pattern, guarded) in zip(FILTERS, PATTERNS))
    return f"(VALUES {rows}) AS f(filter, pattern, guarded)"


@query("topic_matches", "SELECT seq, " + ", ".join(
    f"coalesce(topic LIKE '{like}' AND ({rest}), false) AS {name}" for name, like, rest in [
        ("one_level", "site/canonical/%/device_001/telemetry", "length(topic) - length(replace(topic, '/', '')) = 4"),
        ("all_below", "site/%", "true"),
        ("everything", "%", "topic NOT LIKE '$%'"),
        ("system", "$SYS/%", "true"),
        ("exact", "Door Lock", "true"),
    ]) + " FROM traffic", "traffic")
def topic_matches(t: Tables) -> DataFrame:
    tested = {"one_level": FILTERS[0], "all_below": "site/#", "everything": "#", "system": "$SYS/#", "exact": "Door Lock"}
    return t.traffic.select("seq", *[
        topics.topic_matches(F.col("topic"), f).alias(name) for name, f in tested.items()])


@query("match_subscriptions", f"""
    SELECT seq, topic, filter FROM traffic JOIN {_filter_list()}
      ON regexp_matches(topic, pattern) AND NOT (guarded AND topic LIKE '$%')""", "traffic")
def match_subscriptions(t: Tables) -> DataFrame:
    return subscriptions.match_subscriptions(
        t.traffic.select("seq", "topic"), subscriptions.filter_table(t.spark, FILTERS))


# every message is also the source of a filter: its topic with wildcards where a hash of its number has ones, odd ones cut
# short and open at the end
DEEP_TOPIC = "topic || '/' || (seq // 1000) % 10 || '/' || (seq // 100) % 10 || '/' || (seq // 10) % 10 || '/' || seq % 10"


def _masked(levels: str, mask: str) -> str:
    return f"list_transform({levels}, lambda x, i: CASE WHEN ({mask} >> (i - 1)) & 1 = 1 THEN '+' ELSE x END)"


@query("match_subscriptions_many", f"""
    WITH d AS (SELECT seq, {DEEP_TOPIC} AS topic, string_split({DEEP_TOPIC}, '/') AS p FROM traffic WHERE topic IS NOT NULL),
    f AS (SELECT DISTINCT CASE WHEN seq % 2 = 0 THEN array_to_string({_masked("p", "(seq * 7919) % 512")}, '/')
      ELSE array_to_string({_masked("p[:seq % len(p) + 1]", "(seq * 7919) % 512")}, '/') || '/#' END AS filter FROM d),
    c AS (SELECT seq, topic, p, cut, unnest(range(1 << cut)) AS mask
      FROM (SELECT *, unnest(range(1, len(p) + 1)) AS cut FROM d)),
    e AS (SELECT seq, topic, unnest([array_to_string(m, '/') || '/#', CASE WHEN cut = len(p) THEN array_to_string(m, '/') END]) AS filter
      FROM (SELECT *, {_masked("p[:cut]", "mask")} AS m FROM c WHERE NOT (topic LIKE '$%' AND mask & 1 = 1)))
    SELECT seq, count(*) AS filters, min(filter) AS first_filter, max(filter) AS last_filter
    FROM (SELECT DISTINCT seq, filter FROM e JOIN f USING (filter)) GROUP BY seq""", "traffic")
def match_subscriptions_many(t: Tables) -> DataFrame:
    digits = [(F.floor(F.col("seq") / 10 ** k) % 10).cast("string") for k in (3, 2, 1, 0)]
    deep = t.traffic.where("topic IS NOT NULL").select("seq", F.concat_ws("/", "topic", *digits).alias("topic"))
    levels, mask = F.split("topic", "/"), F.col("seq") * 7919 % 512
    masked = F.transform(levels, lambda x, i: F.when(F.call_function("getbit", mask, i) == 1, "+").otherwise(x))
    cut = F.concat(F.array_join(F.slice(masked, 1, (F.col("seq") % F.size(levels) + 1).cast("int")), "/"), F.lit("/#"))
    filters = deep.select(F.when(F.col("seq") % 2 == 0, F.array_join(masked, "/")).otherwise(cut).alias("filter"))
    matched = subscriptions.match_subscriptions(deep, filters.distinct(), listed=True)
    sizes = matched.select("seq", F.size("filters").alias("filters"), F.array_min("filters").alias("first_filter"),
                           F.array_max("filters").alias("last_filter"))
    return sizes.groupBy("seq").agg(F.coalesce(F.sum("filters"), F.lit(0)).alias("filters"),
                                    F.min("first_filter").alias("first_filter"), F.max("last_filter").alias("last_filter"))


@query("device_from_topic", """
    SELECT seq, CASE WHEN len(p) < 3 OR p IS NULL THEN 'unknown' WHEN contains(p[-2], 'device') THEN p[-3] ELSE p[-2] END
      AS device FROM (SELECT seq, string_split(topic, '/') AS p FROM traffic)""", "traffic")
def device_from_topic(t: Tables) -> DataFrame:
    return t.traffic.select("seq", topics.device_from_topic(F.col("topic")).alias("device"))


# --- devices ---

def _types_of(sample: str, topic: str) -> str:
    found = ", ".join(
        f"CASE WHEN regexp_matches(lower({sample} || chr(10) || {topic}), '{'|'.join(patterns).lower()}') THEN '{name}' END"
        for name, patterns in DEVICE_PATTERNS.items())
    return f"unnest(list_filter([{found}], lambda d: d IS NOT NULL))"


# topics and payloads of the traffic mention few devices, so the queries add the device names of the city
DEVICE_TOPIC = """CASE seq % 7 WHEN 0 THEN 'vibration/cooler-' || event_type WHEN 1 THEN 'hydraulic/rig-1'
  WHEN 2 THEN 'city/air/' || event_type WHEN 3 THEN 'home/Soil_Moisture/1' ELSE topic END"""
DEVICES = f"""devices AS (SELECT seq, ts, event_type, {DEVICE_TOPIC} AS topic, payload AS "Payload_sample" FROM traffic),
  classified AS (SELECT *, {_types_of("coalesce(Payload_sample, '')", "coalesce(topic, '')")} AS device_type FROM devices)"""


def _classified(t: Tables) -> DataFrame:
    rows = t.traffic.select("seq", "ts", F.expr(DEVICE_TOPIC).alias("topic"), F.col("payload").alias("Payload_sample"))
    return devices.classify_devices(rows)


@query("classify_devices", f"WITH {DEVICES} SELECT seq, device_type FROM classified", "traffic")
def classify_devices(t: Tables) -> DataFrame:
    return _classified(t).select("seq", "device_type")


def _sampled(n: int) -> str:
    return f"""WITH {DEVICES} SELECT device_type, seq FROM classified
      QUALIFY row_number() OVER (PARTITION BY device_type ORDER BY md5('0:' || seq), seq) <= {n}"""


@query("sample_per_device", _sampled(300), "traffic")
def sample_per_device(t: Tables) -> DataFrame:
    return devices.sample_per_device(_classified(t), "seq", n=300).select("device_type", "seq")


@query("sample_per_device_large", _sampled(2000), "traffic")
def sample_per_device_large(t: Tables) -> DataFrame:
    return devices.sample_per_device(_classified(t), "seq", n=2000).select("device_type", "seq")


@query("device_counts", f"""
    WITH {DEVICES}, known AS (SELECT unnest([{", ".join(f"'{name}'" for name in DEVICE_PATTERNS)}]) AS device_type)
    SELECT device_type, count(seq) AS records FROM known LEFT JOIN classified USING (device_type) GROUP BY device_type
    """, "traffic")
def device_counts(t: Tables) -> DataFrame:
    return devices.device_counts(_classified(t))


INDEXED = f"""{DEVICES}, indexed AS (SELECT *, row_number() OVER (
    PARTITION BY device_type ORDER BY ts NULLS LAST, seq) - 1 AS record_index FROM classified),
  repaired AS (SELECT *, CASE WHEN topic LIKE '%/%' THEN topic ELSE 'site/canonical/' || lower(device_type) || '/device_'
    || lpad(CAST(record_index % 5 + 1 AS VARCHAR), 3, '0') || '/telemetry' END AS new_topic FROM indexed)"""


@query("repair_topic", f"""
    WITH {INDEXED} SELECT seq, device_type, record_index, new_topic AS topic FROM repaired""", "traffic")
def repair_topic(t: Tables) -> DataFrame:
    rows = devices.record_index(_classified(t).select("seq", "ts", "topic", "device_type"), Order(("device_type",)))
    fixed = topics.repair_topic(F.col("topic"), F.col("device_type"), F.col("record_index"))
    return rows.select("seq", "device_type", "record_index", fixed.alias("topic"))


STAMP = "2024-02-01T00:00:00+00:00"
ADDED = f"""'simulator_timestamp', '{STAMP}', 'canonical_record_id', record_id, 'flow_stage', 'canonical_to_mqtt'"""
ENRICHED = f"""CASE WHEN payload LIKE '%"device_type"%' THEN json_merge_patch(
      CAST(replace(payload, '"Fan"', '"' || device_type || '"') AS JSON),
      json_object('canonical_source', 'dataset_canonical', {ADDED}))
  WHEN payload LIKE '{{%' OR payload = '' THEN json_merge_patch(
      CAST(CASE WHEN payload = '' THEN '{{}}' ELSE payload END AS JSON),
      json_object('canonical_source', 'dataset_canonical', 'device_type', device_type, {ADDED}))
  ELSE json_object('device_type', device_type, 'canonical_source', 'dataset_canonical',
      'raw_payload', payload[1:100], 'simulator_timestamp', '{STAMP}') END"""


@query("enrich_payload", f"""
    SELECT seq, CAST({ENRICHED} AS VARCHAR) AS payload
    FROM (SELECT seq, payload, event_type AS device_type, seq AS record_id FROM traffic)""", "traffic")
def enrich_payload(t: Tables) -> DataFrame:
    rows = t.traffic.select("seq", "event_type", F.col("payload").alias("original"))
    return payloads.with_enriched_payload(
        rows, F.col("original"), F.col("event_type"), F.col("seq"), F.lit(STAMP)).select("seq", "payload")


@query("replay_records", f"""
    WITH {INDEXED} SELECT seq, new_topic AS topic, CAST({ENRICHED} AS VARCHAR) AS payload
    FROM (SELECT *, "Payload_sample" AS payload, record_index AS record_id FROM repaired)""", "traffic")
def replay_records(t: Tables) -> DataFrame:
    return devices.replay_records(_classified(t), F.lit(STAMP)).select("seq", "topic", "payload")


# --- messages ---

@query("decode_payload", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 2) END AS text FROM documents""")
def decode_payload(t: Tables) -> DataFrame:
    """Every other document starts with a byte sequence that is cut short, which has to go."""
    whole = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("e282")), F.encode(F.substring("text", 2, 2 ** 31 - 1), "UTF-8"))
    payload = F.when(F.col("doc_id") % 2 == 0, whole).otherwise(broken)
    return t.table("documents").select("doc_id", text.decode_payload(payload).alias("text"))


IDENTITY = """coalesce(CASE WHEN payload LIKE '{{%' THEN coalesce(json_extract_string(payload, '$.device_id'),
    json_extract_string(payload, '$.client_id')) END, 'unknown')""".replace("{{", "{")
DEVICE_TYPE = """coalesce(CASE WHEN payload LIKE '{{%' THEN json_extract_string(payload, '$.device_type') END, 'unknown')
    """.replace("{{", "{")


@query("payload_identity", f"""
    SELECT seq, {IDENTITY} AS client_id, {DEVICE_TYPE} AS device_type FROM traffic""", "traffic")
def payload_identity(t: Tables) -> DataFrame:
    return payloads.with_identity(t.traffic.select("seq", "payload"), F.col("payload")).drop("payload")


COLLECTED = f"""
    SELECT strftime(coalesce(ts, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS "timestamp",
      '192.168.1.unknown' AS src_ip, '50000' AS src_port, 'localhost' AS dst_ip, '1883' AS dst_port,
      {IDENTITY} AS client_id, topic, qos, retain, CAST(0 AS INTEGER) AS dupflag,
      CAST(length(payload) AS INTEGER) AS payload_length, payload[1:200] AS payload_sample, 'PUBLISH' AS packet_type,
      'MQTT' AS protocol, CAST(NULL AS BIGINT) AS msgid, 'broker_to_detection' AS flow_stage, 'Unknown' AS label,
      CASE WHEN {DEVICE_TYPE} <> 'unknown' THEN {DEVICE_TYPE} WHEN len(p) < 3 THEN 'unknown'
        WHEN contains(p[-2], 'device') THEN p[-3] ELSE p[-2] END AS device_type
    FROM (SELECT * REPLACE (coalesce(topic, 'lost') AS topic), string_split(coalesce(topic, 'lost'), '/') AS p
      FROM traffic)"""


@query("collect_messages", COLLECTED, "traffic")
def collect_messages(t: Tables) -> DataFrame:
    return messages.collect_messages(t.messages)


@query("collection_stats", """
    SELECT count(*) AS messages, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000, 3) AS runtime_sec,
      round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000), 6) AS messages_per_sec
    FROM traffic""", "traffic")
def collection_stats(t: Tables) -> DataFrame:
    return messages.collection_stats(t.traffic).select(
        "messages", F.round("runtime_sec", 3).alias("runtime_sec"), F.round("messages_per_sec", 6).alias("messages_per_sec"))


@query("interval_stats", """
    SELECT epoch_us(ts) // 10000000 * 10000000 AS interval_start, count(*) AS messages, count(*) / 10 AS messages_per_sec
    FROM traffic WHERE ts IS NOT NULL GROUP BY 1""", "traffic")
def interval_stats(t: Tables) -> DataFrame:
    return messages.interval_stats(t.traffic).withColumn("interval_start", F.unix_micros("interval_start"))
