"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.functions.text import matched

# Plain decimal notation only: a bare cast would also accept type suffixes such as 1.5d, and fail slowly on
# other text. The patterns test the shape; numbers beyond the range of a double or bigint become null.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
WHOLE = r"^\s*([+-]?\d+)(?:\.0*)?\s*$"
WITH_EXPONENT = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)\s*$"


def number_text(value: Column) -> Column:
    """The number a text consists of, as text; null for anything else."""
    return matched(value.cast("string"), NUMBER, 1)


def to_number(value: Column) -> Column:
    """Text to DOUBLE; anything that is not a plain finite number gives null."""
    return _finite(number_text(value).try_cast("double"))


def _finite(number: Column) -> Column:
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def to_whole_number(value: Column) -> Column:
    """Text to BIGINT; fractional, oversized or malformed text gives null."""
    text = value.cast("string")
    scientific = _finite(matched(text, WITH_EXPONENT, 1).try_cast("double"))
    return F.coalesce(
        matched(text, WHOLE, 1).try_cast("bigint"),
        F.when(scientific == F.floor(scientific), scientific.try_cast("bigint")))


def numeric_field(value: Column | None, default: int | None = 0) -> Column:
    """Whole number with a default for null and malformed text (``None`` keeps them null)."""
    number = F.lit(None).cast("bigint") if value is None else to_whole_number(value)
    if default is None:
        return number
    return F.coalesce(number, F.lit(default).cast("bigint"))
