"""Text clean-up, hex payloads and byte decoding.

The expressions are written so that each input is evaluated once on the common path: a test and its result come
from one ``matched`` call instead of a condition that repeats the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.schemas import TRUE_WORDS

# Characters a Python ``str.strip()`` removes, as far as they occur in practice.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
SAMPLE_LIMIT = 120

_REPLACEMENT = "�"
_STAND_IN = "﷐"  # Unicode noncharacter, never used for text


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern (or one of its groups), null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def not_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def string_field(value: Column | None, default: str = "") -> Column:
    """Trimmed text with null as ``''``; an absent column gives ``default``."""
    if value is None:
        return F.lit(default)
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def bool_flag(value: Column | None) -> Column:
    if value is None:
        return F.lit(0).cast("bigint")
    word = F.lower(string_field(value))
    return word.isin(TRUE_WORDS).cast("bigint")


def _readable(text: Column, limit: int) -> Column:
    printable = F.regexp_replace(text, r"[^\x20-\x7E]+", "")
    return F.substring(F.trim(F.regexp_replace(printable, " {2,}", " ")), 1, limit)


def sanitize_text(text: Column, limit: int = SAMPLE_LIMIT) -> Column:
    """Keep printable ASCII, collapse runs of spaces, trim, then cut to ``limit``."""
    return _readable(F.coalesce(text, F.lit("")), limit)


def hex_digits(text: Column) -> Column:
    """The digits of a hex payload, which may be set apart by colons and blanks; null for other text."""
    return matched(F.translate(strip(text), ": ", ""), "^[0-9a-fA-F]+$")


def decode_hex_payload(text: Column, limit: int = SAMPLE_LIMIT) -> Column:
    """Hex payload to readable text; unreadable bytes stay hex, other text is sanitised.

    Only printable ASCII survives sanitising, and a UTF-8 decoder that skips bad bytes never
    swallows an ASCII byte, so a Latin-1 decode gives the same result and cannot fail.
    """
    raw = F.unhex(hex_digits(text))
    readable = not_empty(_readable(F.decode(raw, "ISO-8859-1"), limit))
    as_hex = F.lower(F.hex(F.substring(raw, 1, limit)))
    return F.coalesce(readable, as_hex, sanitize_text(strip(text), limit))


def hex_length(text: Column) -> Column:
    """Byte count of a hex payload (odd length rounds down), else the text length."""
    return F.coalesce(F.floor(F.length(hex_digits(text)) / 2), F.length(strip(text)), F.lit(0)).cast("bigint")


def decode_payload(payload: Column) -> Column:
    """Bytes to text, dropping bytes that are not valid UTF-8 but keeping a genuine U+FFFD."""
    shielded = F.replace(payload.cast("string"), F.lit(_REPLACEMENT), F.lit(_STAND_IN))
    cleaned = F.replace(F.make_valid_utf8(shielded), F.lit(_REPLACEMENT), F.lit(""))
    return F.replace(cleaned, F.lit(_STAND_IN), F.lit(_REPLACEMENT))
