"""Statistics over recorded attack logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators.ordered import Order, last_state
from telemill.schemas import ANOMALY_TYPES, REQUIRED_LOG_FIELDS


def _is(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _true(column: str) -> Column:
    return F.coalesce(F.lower(F.col(column).cast("string")) == "true", F.lit(False))


def required_fields(attack: str) -> dict[str, list[str]]:
    """Required fields by the first family whose name occurs in the attack's name; none if unknown."""
    for family, fields in REQUIRED_LOG_FIELDS.items():
        if family in attack.lower():
            return fields
    return {}


def check_required_fields(df: DataFrame, attack: str) -> DataFrame:
    """One row: entries, missing fields, values present per required field, and whether the log complies."""
    fields = required_fields(attack)
    present = {name: next((alias for alias in aliases if alias in df.columns), None)
               for name, aliases in fields.items()}
    missing = [name for name, column in present.items() if column is None]
    filled = F.array(*[
        F.struct(F.lit(name).alias("field"), F.count(column).alias("filled"))
        for name, column in present.items() if column]) if any(present.values()) else F.array().cast(
            "array<struct<field:string,filled:bigint>>")
    return df.agg(F.count("*").alias("entries"), filled.alias("filled")).select(
        F.lit(attack).alias("attack"), "entries",
        F.array(*[F.lit(m) for m in missing]).cast("array<string>").alias("missing"), "filled",
        ((F.col("entries") > 0) & F.lit(not missing)).alias("compliant"))


def compliance_summary(logs: dict[str, DataFrame]) -> DataFrame:
    """Entries and compliance per log, with an ``overall`` row counting the compliant ones."""
    per_log = reduce(DataFrame.unionByName, [
        check_required_fields(df, attack).select("attack", "entries", "compliant") for attack, df in logs.items()])
    overall = per_log.groupBy().agg(
        F.lit("overall").alias("attack"), F.sum("entries").alias("entries"),
        F.count_if("compliant").alias("compliant_logs"), F.count("*").alias("logs"))
    return per_log.select(
        "attack", "entries", F.col("compliant").cast("bigint").alias("compliant_logs"),
        F.lit(1).cast("bigint").alias("logs")).unionByName(overall)


def flood_stats(df: DataFrame) -> DataFrame:
    """Messages per client, failed ones included."""
    return df.groupBy("client_id").agg(F.count("*").alias("messages"))


def bruteforce_stats(df: DataFrame) -> DataFrame:
    """Subscriptions granted and denied, connections, and acknowledgement latency in milliseconds."""
    suback = _is("packet_type", "SUBACK")
    latency = F.when(suback, F.col("latency_ms"))
    return df.agg(
        F.count_if(suback & _is("status", "granted")).alias("granted"),
        F.count_if(suback & _is("status", "denied")).alias("denied"),
        F.count_if(_is("packet_type", "CONNECT") & _is("status", "success")).alias("connected"),
        F.count_if(_is("packet_type", "CONNECT") & _is("status", "failed")).alias("refused"),
        F.avg(latency).alias("avg_latency_ms"),
        F.percentile_approx(latency, 0.95).alias("p95_latency_ms"),
        F.max(latency).alias("max_latency_ms"))


def latency_sketches(df: DataFrame, *by: str, k: int = 800) -> DataFrame:
    """Per value of ``by`` the number of SUBACK latencies and a quantile sketch of them, a few kilobytes to be stored.

    Sketches of different logs or days can be merged without their rows; with k = 800 a quantile's rank is off by less than
    half a percent of all rows, nearly always.
    """
    latency = F.when(_is("packet_type", "SUBACK") & F.col("latency_ms").isNotNull(), F.col("latency_ms").cast("double"))
    return df.where(latency.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("latencies"), F.kll_sketch_agg_double(latency, k).alias("sketch"))


def merged_latency(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """quantile, latencies, latency_ms over all logs that the sketches stand for."""
    merged = sketches.agg(F.sum("latencies").alias("latencies"), F.kll_merge_agg_double("sketch").alias("sketch"))
    points = F.array(*[F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("latency_ms"))
                       for q in quantiles])
    return merged.where(F.col("latencies") > 0).select("latencies", F.inline(points)).select("quantile", "latencies", "latency_ms")


def _discovered() -> Column:
    return _is("action", "message_received", "wildcard_message")


def enumeration_stats(df: DataFrame) -> DataFrame:
    """Attempts, successes, received messages and distinct topics; error rows are no attempts.

    Wildcard subscriptions are attempts but never counted as successes.
    """
    attempt = _is("action", "subscribe_attempt", "wildcard_subscribe") & _is("status", "subscribed", "failed")
    return df.agg(
        F.count_if(attempt).alias("subscription_attempts"),
        F.count_if(_is("action", "subscribe_attempt") & _is("status", "subscribed")).alias("successful_subscriptions"),
        F.count_if(_discovered()).alias("received_messages"),
        F.count_distinct(F.when(_discovered(), F.col("topic"))).alias("discovered_topics"))


def discovered_topics(df: DataFrame) -> DataFrame:
    return df.where(_discovered()).select("topic").distinct().orderBy("topic")


def duplicate_id_stats(df: DataFrame) -> DataFrame:
    """Attempts, successes, disconnections; conflicts as counted (session present on connect) and as flagged."""
    attempt = _is("action", "connect_attempt")
    return df.agg(
        F.count_if(attempt & _is("status", "connected", "failed")).alias("connection_attempts"),
        F.count_if(attempt & _is("status", "connected")).alias("successful_connections"),
        F.count_if(_is("action", "disconnect")).alias("disconnections"),
        F.count_if(attempt & _is("status", "connected") & _true("session_present")).alias("counted_conflicts"),
        F.count_if(_true("conflict_detected")).alias("flagged_conflicts"))


def handshake_steps() -> tuple[Column, Column]:
    """Whether a row opens a handshake (PUBLISH) or completes one (PUBCOMP)."""
    return _is("action", "publish") & _is("handshake_step", "PUBLISH"), _is("handshake_step", "PUBCOMP")


def qos2_pairing(df: DataFrame, ts: str = "ts", seq: str = "seq", **order_options) -> DataFrame:
    """Every PUBCOMP with the seconds since its PUBLISH of the same client and message id.

    A PUBCOMP uses up the PUBLISH before it, so a second one is unexpected and has no time.
    """
    publish, complete = handshake_steps()
    state = F.when(publish | complete, F.struct(publish.alias("open"), F.col(ts).alias("at")))
    order = Order(("client_id", "message_id"), ts=ts, seq=seq, **order_options)
    relevant = df.where(publish | complete)
    paired = last_state(relevant, order, state, "_before").where(complete)
    expected = F.coalesce(F.col("_before.open"), F.lit(False))
    seconds = (F.unix_micros(ts) - F.unix_micros(F.col("_before.at"))) / 1_000_000
    return paired.select(
        "client_id", "message_id", ts, seq,
        F.when(expected, seconds).alias("handshake_sec"),
        (~expected).alias("unexpected"))


def qos2_stats(df: DataFrame) -> DataFrame:
    """Message, acknowledgement and failure counts, completion rate, mean duration of mixed handshakes."""
    duration = F.regexp_extract("details", r"duration=([0-9.]+)s", 1).try_cast("double")
    counts = df.agg(
        F.count_if(_is("action", "publish") & _is("handshake_step", "PUBLISH")).alias("published"),
        F.count_if(_is("action", "message_received", "qos2_message_received")).alias("received"),
        F.count_if(_is("handshake_step", "PUBREC")).alias("pubrec"),
        F.count_if(_is("handshake_step", "PUBCOMP")).alias("pubcomp"),
        F.count_if(_is("action", "publish") & _is("status", "failed", "exception")).alias("failures"),
        F.avg(F.when(_is("action", "mixed_handshake"), duration)).alias("mixed_handshake_sec"))
    rate = F.when(F.col("published") > 0, F.col("pubcomp") / F.col("published") * 100)
    return counts.withColumn("completion_percent", rate)


def reconnect_stats(df: DataFrame) -> DataFrame:
    """Connections, disconnections, failures, still active ones and success rate (null without connections)."""
    connect = _is("action", "connect", "bomb_connect")
    ok, failed = connect & _is("status", "success"), connect & _is("status", "failed")
    counts = df.agg(
        F.count_if(ok | failed).alias("connections"),
        F.count_if(_is("action", "disconnect", "bomb_disconnect")).alias("disconnections"),
        F.count_if(failed | (_is("action", "connect") & _is("status", "exception"))).alias("failures"),
        F.count_if(ok).alias("_ok"))
    rate = F.when(F.col("connections") > 0,
                  (F.col("connections") - F.col("failures")) / F.col("connections") * 100)
    return counts.select(
        "connections", "disconnections", "failures", (F.col("_ok") - F.col("disconnections")).alias("active"),
        rate.alias("success_percent"))


def _sent() -> Column:
    """Rows that raise the sent counter; creating and clearing retained test topics does not."""
    return ((_is("attack_type", "retain_flood") & _is("status", "sent"))
            | (_is("attack_type", "qos2_abuse", "mixed_qos_retain") & _is("status", "sent", "failed")))


def retain_qos_stats(df: DataFrame) -> DataFrame:
    retained = _is("attack_type", "retain_flood") & _is("status", "sent")
    return df.agg(
        F.count_if(_sent()).alias("sent"),
        F.count_distinct(F.when(retained, F.col("topic"))).alias("retained_topics"))


def retain_qos_rate(df: DataFrame, ts: str = "ts", interval_seconds: int = 10) -> DataFrame:
    """Counted messages per second and reporting interval."""
    return (df.where(_sent()).groupBy(F.window(ts, f"{interval_seconds} seconds").alias("_window"))
            .agg(F.count("*").alias("sent"))
            .select(F.col("_window.start").alias("interval_start"), "sent",
                    (F.col("sent") / interval_seconds).alias("messages_per_sec")))


def payload_anomaly_stats(df: DataFrame) -> DataFrame:
    """Rows per anomaly type and status, with an ``all`` row."""
    status = {name: F.count_if(_is("status", name)).alias(name) for name in ("sent", "failed", "error")}
    kind = F.when(_is("anomaly_type", *ANOMALY_TYPES), F.col("anomaly_type")).otherwise(F.lit("other"))
    per_kind = df.groupBy(kind.alias("anomaly_type")).agg(*status.values())
    total = per_kind.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in status]).select(
        F.lit("all").alias("anomaly_type"), *status)
    return per_kind.unionByName(total)
