"""Rule-based detection over feature rows: counts over the whole run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.ordered import AT, Order, first_occurrences, running_totals
from telemill.schemas import ALERT_COLUMNS


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    action: str
    threshold: int | None = None
    window_seconds: int | None = None
    patterns: tuple[str, ...] = ()
    max_size: int | None = None
    min_size: int | None = None

    @property
    def blocked(self) -> bool:
        return self.action == "BLOCK"


# --- fixed values: the nine rules ---
DEFAULT_RULES = {
    "flood_detection": Rule("Message Flood Attack", "HIGH", "BLOCK", threshold=100, window_seconds=60),
    "topic_enumeration": Rule("Topic Enumeration Attack", "MEDIUM", "ALERT", threshold=20, window_seconds=60),
    "wildcard_abuse": Rule("Wildcard Subscription Abuse", "MEDIUM", "ALERT", patterns=("#", "+/#", "$SYS/#", "*")),
    "payload_anomaly": Rule("Payload Anomaly Attack", "MEDIUM", "ALERT", max_size=10000, min_size=1),
    "qos_abuse": Rule("QoS Level Abuse", "LOW", "MONITOR", threshold=50, window_seconds=3600),
    "reconnect_storm": Rule("Reconnection Storm Attack", "HIGH", "BLOCK", threshold=10, window_seconds=60),
    "duplicate_client": Rule("Duplicate Client ID Attack", "MEDIUM", "ALERT", threshold=1, window_seconds=60),
    "retain_abuse": Rule("Retain Message Abuse", "MEDIUM", "ALERT", threshold=100, window_seconds=3600),
    "system_topic_access": Rule(
        "Unauthorized System Topic Access", "HIGH", "BLOCK", patterns=("$SYS/", "$share/", "$queue/")),
}

# Checks in the order they are made for one row.
CHECK_ORDER = [
    "flood_detection", "topic_enumeration", "wildcard_abuse", "payload_anomaly", "qos_abuse",
    "system_topic_access", "retain_abuse",
]
STATELESS = ["wildcard_abuse", "payload_anomaly", "system_topic_access"]


@dataclass(frozen=True)
class Rules:
    """The rule table; ``Rules().override(flood_detection={"threshold": 10})`` changes single values."""

    table: dict[str, Rule] = field(default_factory=lambda: dict(DEFAULT_RULES))

    def __getitem__(self, key: str) -> Rule:
        return self.table[key]

    def override(self, **changes: dict) -> "Rules":
        return Rules({key: replace(rule, **changes.get(key, {})) for key, rule in self.table.items()})

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(key, r.name, r.severity, r.action, r.threshold, r.window_seconds, list(r.patterns), r.max_size,
                 r.min_size) for key, r in self.table.items()]
        return spark.createDataFrame(
            rows, "rule STRING, name STRING, severity STRING, action STRING, threshold INT, window_seconds INT, "
                  "patterns ARRAY<STRING>, max_size INT, min_size INT")


def _or_default(present: list[str], names: tuple[str, ...], default) -> Column:
    for name in names:
        if name in present:
            return F.col(name)
    return F.lit(default)


@dataclass(frozen=True)
class Inputs:
    """What the rules read from a feature row; absent columns get their defaults."""

    topic: Column
    payload_length: Column
    qos: Column
    retained: Column

    @classmethod
    def of(cls, df: DataFrame) -> "Inputs":
        return cls.among(df.columns)

    @classmethod
    def among(cls, present: list[str]) -> "Inputs":
        return cls(
            topic=_or_default(present, ("topic",), ""),
            payload_length=_or_default(present, ("payload_length",), 0).cast("bigint"),
            qos=_or_default(present, ("qos",), 0),
            retained=F.coalesce(_or_default(present, ("retain", "retain_flag"), 0).cast("int") != 0, F.lit(False)))

    @property
    def is_qos2(self) -> Column:
        return F.coalesce(self.qos == 2, F.lit(False))


def _text(prefix: str, value: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix))


def _first_match(patterns: tuple[str, ...], test) -> Column:
    return F.coalesce(*[F.when(test(p), F.lit(p)) for p in patterns])


# Running count each counting rule needs.
COUNTED = {
    "flood_detection": "messages", "topic_enumeration": "topics", "qos_abuse": "qos2", "retain_abuse": "retained",
}


def findings(rules: Rules, inputs: Inputs, counts: dict[str, Column]) -> dict[str, Column]:
    """Description of the alert each rule raises for a row, null for none.

    ``counts`` holds the running counts there are; a counting rule without its count is left out. A row
    without a topic cannot be checked past the first two counting rules.
    """
    topic, size = inputs.topic, inputs.payload_length
    has_topic = topic.isNotNull()
    found = {}
    wildcard = _first_match(rules["wildcard_abuse"].patterns, lambda p: F.contains(topic, F.lit(p)))
    found["wildcard_abuse"] = F.concat(F.lit("Wildcard pattern detected: "), wildcard)
    limits = rules["payload_anomaly"]
    found["payload_anomaly"] = F.when(
        has_topic & ((size > limits.max_size) | (size < limits.min_size)),
        _text("Anomalous payload size: ", size, " bytes"))
    system = _first_match(rules["system_topic_access"].patterns, lambda p: F.startswith(topic, F.lit(p)))
    found["system_topic_access"] = F.concat(F.lit("Access to system topic: "), system)
    limit = {key: rules[key].threshold for key in COUNTED}
    if "messages" in counts:
        found["flood_detection"] = F.when(
            counts["messages"] > limit["flood_detection"],
            F.lit(f"Client exceeded {limit['flood_detection']} messages"))
    if "topics" in counts:
        found["topic_enumeration"] = F.when(
            counts["topics"] > limit["topic_enumeration"],
            _text("Client accessed ", counts["topics"], " unique topics"))
    if "qos2" in counts:
        found["qos_abuse"] = F.when(
            has_topic & (counts["qos2"] > limit["qos_abuse"]),
            _text("Excessive QoS 2 usage: ", counts["qos2"], " messages"))
    if "retained" in counts:
        found["retain_abuse"] = F.when(
            has_topic & inputs.retained & (counts["retained"] > limit["retain_abuse"]),
            _text("Excessive retain messages: ", counts["retained"], ""))
    return found


def raise_alerts(df: DataFrame, rules: Rules, found: dict[str, Column], topic: Column,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per finding, in rule order within a row; a single pass over ``df``."""
    alerts = []
    for key in CHECK_ORDER:
        if key in found:
            rule = rules[key]
            alerts.append(F.when(found[key].isNotNull(), F.struct(
                F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"),
                found[key].alias("description"), F.lit(rule.action).alias("action"),
                F.lit(rule.blocked).alias("blocked"))))
    return (df.withColumn("_topic", topic)
            .withColumn("_alert", F.explode(F.array_compact(F.array(*alerts))))
            .select(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                "_alert.rule_name", "_alert.severity", "client_id", F.col("_topic").alias("topic"),
                "_alert.description", "_alert.action", "_alert.blocked", *keep)
            .select(*ALERT_COLUMNS, *keep))


def client_counts(features: DataFrame, order: Order, names: tuple[str, ...] = tuple(COUNTED.values())) -> DataFrame:
    """Add running counts per client: messages, distinct topics, QoS 2 messages, retained messages."""
    present = features.columns
    inputs = Inputs.among(present)
    with_topic = features if "topic" in present else features.withColumn("topic", inputs.topic)
    increments = {
        "messages": F.lit(1),
        "topics": F.lit(0),
        "qos2": inputs.is_qos2.cast("int"),
        # rows without a topic are never checked for retention, so they do not count towards it
        "retained": (inputs.retained & inputs.topic.isNotNull()).cast("int"),
    }
    new_topics = first_occurrences(with_topic, order, "topic", "topics") if "topics" in names else None
    return running_totals(with_topic, order, {n: increments[n] for n in names}, new_topics)


def detect(features: DataFrame, rules: Rules | None = None, checks: list[str] | None = None,
           once_per_client: bool = False, keep: tuple[str, ...] = (), **order_options) -> DataFrame:
    """Alerts of the cumulative rules, one per row and rule past its threshold.

    ``features`` needs ``ts``, ``client_id`` and a unique ``seq``. It is read several times, so hand over a
    written table rather than a long plan. ``checks`` limits the rules, and with them the counting;
    ``once_per_client`` keeps the first alert per client and rule.
    """
    rules = rules or Rules()
    checks = checks or CHECK_ORDER
    order = Order(("client_id",), **order_options)
    present = set(features.columns)
    read = ("ts", "seq", "client_id", "topic", "payload_length", "qos", "retain", "retain_flag", *keep)
    needed = [c for c in dict.fromkeys(read) if c in present]
    rows = features.select(*needed)
    inputs = Inputs.among(needed)
    counts = tuple(COUNTED[key] for key in checks if key in COUNTED)
    if counts:
        rows = client_counts(rows, order, counts)
    found = findings(rules, inputs, {n: F.col(n) for n in counts})
    found = {key: text for key, text in found.items() if key in checks}
    if not once_per_client:
        return raise_alerts(rows, rules, found, inputs.topic, keep)
    placed = raise_alerts(rows.withColumn(AT, order.at), rules, found, inputs.topic,
                          tuple(dict.fromkeys((*keep, AT, order.seq))))
    columns = [c for c in placed.columns if c not in ("client_id", "rule_name")]
    first = F.min_by(F.struct(*columns), F.struct(AT, order.seq)).alias("_first")
    return (placed.groupBy("client_id", "rule_name").agg(first)
            .select("client_id", "rule_name", "_first.*").select(*ALERT_COLUMNS, *keep))


def detect_stateless(rows: DataFrame, rules: Rules | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rules that need no counting; works on streams."""
    return detect(rows, rules, STATELESS, keep=keep)


def client_stats(features: DataFrame) -> DataFrame:
    """Per client: messages, distinct topics, first and last timestamp, payload sizes, QoS 2 messages."""
    inputs = Inputs.of(features)
    return features.groupBy("client_id").agg(
        F.count("*").alias("message_count"),
        F.count_distinct(F.struct(inputs.topic)).alias("topic_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min(inputs.payload_length).alias("min_payload_length"),
        F.max(inputs.payload_length).alias("max_payload_length"),
        F.avg(inputs.payload_length).alias("avg_payload_length"),
        F.count_if(inputs.is_qos2).alias("qos2_count"))


def high_severity(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("severity").isin("HIGH", "CRITICAL"))


def rule_place(rule_name: Column) -> Column:
    """Place of a rule, by its name, in the order of the checks of one row."""
    names = [DEFAULT_RULES[key].name for key in CHECK_ORDER]
    return F.coalesce(*[F.when(rule_name == name, F.lit(i)) for i, name in enumerate(names)], F.lit(len(names)))


def alert_summary(alerts: DataFrame, last_n: int | None = None, features: DataFrame | None = None) -> DataFrame:
    """Alerts by severity and by action, over all alerts or the latest ``last_n``, in one pass.

    Alerts are in the order of their rows, as far as these are known: timestamp with nulls last, then ``seq`` if the
    alerts have it (``keep=("seq",)`` of ``detect``), then the order of the checks. With ``features`` a further row
    counts the clients analysed.
    """
    latest = alerts
    if last_n is not None:
        sequence = [F.col("seq").desc_nulls_first()] if "seq" in alerts.columns else []
        # the remaining columns break ties, so only identical alerts are interchangeable
        rest = [F.col(c).desc_nulls_last() for c in ALERT_COLUMNS]
        latest = alerts.orderBy(F.col("timestamp").desc_nulls_first(), *sequence, rule_place(F.col("rule_name")).desc(),
                                *rest).limit(last_n)
    by_kind = (latest.groupingSets([["severity"], ["action"]], "severity", "action")
               .agg(F.count("*").alias("alerts"), F.grouping("severity").alias("_by_action"))
               .select(F.when(F.col("_by_action") == 1, "action").otherwise("severity").alias("dimension"),
                       F.when(F.col("_by_action") == 1, F.col("action")).otherwise(F.col("severity")).alias("name"),
                       "alerts"))
    if features is None:
        return by_kind
    clients = features.agg(F.count_distinct(F.struct("client_id")).alias("alerts")).select(
        F.lit("clients").alias("dimension"), F.lit("analyzed").alias("name"), "alerts")
    return by_kind.unionByName(clients)
