"""JSON payloads: values, identity, enrichment.

A payload is parsed once, by ``with_json_entries``; the other functions work on its entries. The parse
stays in a projection of its own because its result is used several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.numbers import to_number

# --- fixed values: payload keys that name the measured value, by priority ---
VALUE_KEYS = ["value", "val", "temp", "temperature"]

_NUMERIC_TYPE = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*|BOOLEAN)$"
_ENTRIES = "array<struct<key:string,value:variant>>"


def is_json_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else; null for null.

    Spark's parsers ignore what follows a value. Text with more than one value may still look like the sole item of an
    array, if it closes that array itself, or like the sole member of an object, but not like both. So text without a
    closing bracket is parsed once.
    """
    sole_item = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    sole_member = F.size(F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}")))) == 1
    braces = F.ltrim(text).startswith("{") & F.rtrim(text).endswith("}")
    closes = F.contains(text, F.lit("]"))
    return F.when(text.isNotNull(), F.coalesce(braces & sole_item & (~closes | sole_member), F.lit(False)))


def with_json_entries(df: DataFrame, text: Column, name: str = "_entries") -> DataFrame:
    """Add the entries of a JSON object in document order; null when the text is not one object.

    Values are variants, so a quoted number stays distinguishable from a number. A repeated key
    keeps its first place and its last value.
    """
    parsed = F.from_json(F.when(is_json_object(text), text), "map<string,variant>", {"allowSingleQuotes": "false"})
    entries = F.col(name)
    keys = F.transform(entries, lambda e: e["key"])
    last_of_each = F.transform(
        F.array_distinct(keys),
        lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return (df
            .withColumn(name, F.map_entries(parsed))
            .withColumn(name, F.when(F.size(F.array_distinct(keys)) < F.size(keys), last_of_each)
                        .otherwise(entries)))


def variant_text(value: Column) -> Column:
    """Text of a JSON value; a number with a fraction keeps its decimal point (28.0 is not 28)."""
    return F.coalesce(fraction(value).cast("string"), F.try_variant_get(value, "$", "string"))


def fraction(value: Column) -> Column:
    """A JSON number written with a fraction or exponent as DOUBLE; null for anything else."""
    written = F.schema_of_variant(value).rlike(r"^(DECIMAL|FLOAT|DOUBLE)")
    number = F.when(written, F.try_variant_get(value, "$", "double"))
    return F.when(F.abs(number) < 1e15, number)


def is_number(value: Column) -> Column:
    """JSON numbers and booleans count as numbers, quoted ones do not."""
    return F.schema_of_variant(value).rlike(_NUMERIC_TYPE)


def member(entries: Column, key: str) -> Column:
    """The entry with this key, or null."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))


def chosen_entry(entries: Column) -> Column:
    """The entry that carries the value: a named key first, else the first number."""
    named = [member(entries, key) for key in VALUE_KEYS]
    first_number = F.get(F.filter(entries, lambda e: is_number(e["value"])), F.lit(0))
    return F.coalesce(*named, first_number)


def with_extracted_value(df: DataFrame, text: Column, value: str = "value", number: str = "value_num") -> DataFrame:
    """Add the measured value of a payload as text and as a number.

    ``value`` is the text of the chosen JSON value, or the number a plain text payload holds;
    ``number`` is null unless that value is a JSON number, boolean or plain number.
    """
    entry_value = F.col("_entry")["value"]
    plain = to_number(text)
    json_number = F.when(is_number(entry_value), F.coalesce(
        F.try_variant_get(entry_value, "$", "double"),
        F.try_variant_get(entry_value, "$", "boolean").cast("double")))
    is_object = F.col("_entries").isNotNull()
    return (with_json_entries(df, text)
            .withColumn("_entry", chosen_entry(F.col("_entries")))
            .withColumn(value, F.when(is_object, variant_text(entry_value)).otherwise(plain.cast("string")))
            .withColumn(number, F.when(is_object, json_number).otherwise(plain))
            .drop("_entries", "_entry"))


def with_identity(df: DataFrame, text: Column, client_id: str = "client_id",
                  device_type: str = "device_type") -> DataFrame:
    """Add client and device type named in a JSON object payload, ``unknown`` where there is none."""
    entries, unknown = F.col("_entries"), F.lit("unknown")
    client = F.coalesce(member(entries, "device_id"), member(entries, "client_id"))["value"]
    return (with_json_entries(df, F.when(text.startswith("{"), text))
            .withColumn(client_id, F.coalesce(variant_text(client), unknown))
            .withColumn(device_type, F.coalesce(variant_text(member(entries, "device_type")["value"]), unknown))
            .drop("_entries"))


def with_enriched_payload(df: DataFrame, text: Column, device_type: Column, record_id: Column,
                          stamped_at: Column, name: str = "payload") -> DataFrame:
    """Add a JSON object payload with the tracking fields; other payloads are wrapped as text."""
    source = F.lit("dataset_canonical")
    added = {
        "canonical_source": source,
        "device_type": device_type,
        "simulator_timestamp": stamped_at,
        "canonical_record_id": record_id.cast("bigint"),
        "flow_stage": F.lit("canonical_to_mqtt"),
    }
    blank = F.coalesce(text, F.lit("")).isin("", "{}")
    entries = F.when(blank, F.array().cast(_ENTRIES)).otherwise(F.col("_entries"))
    new = F.array(*[
        F.struct(F.lit(key).alias("key"), value.cast("variant").alias("value")) for key, value in added.items()])
    # a field that is already there keeps its place and takes the new value
    updated = F.transform(entries, lambda e: F.coalesce(
        F.get(F.filter(new, lambda n: n["key"] == e["key"]), F.lit(0)),
        F.struct(e["key"].alias("key"),
                 F.coalesce(fraction(e["value"]).cast("variant"), e["value"]).alias("value"))))
    appended = F.filter(new, lambda n: ~F.exists(entries, lambda e: e["key"] == n["key"]))
    merged = F.to_json(F.map_from_entries(F.concat(updated, appended)))
    wrapped = F.to_json(F.struct(
        device_type.alias("device_type"),
        source.alias("canonical_source"),
        F.substring(F.coalesce(text, F.lit("")), 1, 100).alias("raw_payload"),
        stamped_at.alias("simulator_timestamp")))
    return (with_json_entries(df, text)
            .withColumn(name, F.when(entries.isNotNull(), merged).otherwise(wrapped))
            .drop("_entries"))
