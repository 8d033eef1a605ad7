"""Timestamps in their many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.functions.numbers import number_text
from telemill.functions.text import strip

# The grammar of dates that are not ISO 8601: orders of year, month and day, a clock, a zone. A month is a number or a name
# of at least three letters. Fractions have up to nine digits, of which six count.
_CLOCK = r"(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(Z|[A-Z]{3}|[+-]\d{2}:?\d{2})"
_NAME = r"([A-Za-z]{3})[A-Za-z]{0,6}\.?"
_DATE = "|".join([
    r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})",                               # 1 year, 2 month, 3 day
    r"(1[3-9]|[23]\d)[-/.](\d{1,2})[-/.](\d{4})",                         # 4 day, 5 month, 6 year
    r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})",                               # 7 month, 8 day, 9 year
    rf"(\d{{1,2}})[- ]{_NAME},?[- ](\d{{4}})",                             # 10 day, 11 month, 12 year
    rf"{_NAME} +(\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})",                  # 13 month, 14 day, 15 year
])
# 16 to 20 the clock, 21 the zone; or 22 month, 23 day, 24 to 28 the clock, 29 the zone, 30 year
_SPELLING = (rf"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,? +)?(?:(?:{_DATE})(?:(?: +|, *|T){_CLOCK}(?: *{_ZONE})?)?"
             rf"|{_NAME} +(\d{{1,2}}) +{_CLOCK}(?: {_ZONE})? (\d{{4}}))$")
# Groups that had no part are empty, so one template serves all orders. Half days are written as a and p.
_FIELDS = "$1$6$9$12$15$30/$2$5$7$11$13$22/$3$4$8$10$14$23/$16$24/$17$25/$18$26/.$19$27000000/$20$28/$21$29"
_FORMATS = [f"y/[MMM][M]/d/{clock}/[XXX][XX][z]" for clock in ("[H]/[m]/[s]/.SSSSSS/", "[h]/[m]/[s]/.SSSSSS/a")]
# Two digits of a year stand for 1969 to 2068.
_CENTURIES = [(r"^(\d{1,2}[-/.]\d{1,2}[-/.]|\d{1,2}[- ][A-Za-z]{3,9}[- ])([0-5]\d|6[0-8])(?!\d)", "$120$2"),
              (r"^(\d{1,2}[-/.]\d{1,2}[-/.]|\d{1,2}[- ][A-Za-z]{3,9}[- ])(\d{2})(?!\d)", "$119$2")]

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def epoch_ts(value: Column) -> Column:
    """Epoch seconds as text to a timestamp, exact to the microsecond.

    Seconds whose nanoseconds do not fit 64 bits are no dates: the product overflows to null.
    """
    micros = (number_text(value).try_cast("decimal(16,6)") * 1_000_000).try_cast("bigint")
    nanos = F.try_multiply(micros, F.lit(1000).cast("bigint"))
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))


def spelled_ts(text: Column) -> Column:
    """A date written by people: its fields are captured in one match, put in one order and read; null where that fails.

    Dates of three numbers that begin with one or two digits are month first, unless the first can't be a month.
    """
    for pattern, century in _CENTURIES:
        text = F.regexp_replace(text, pattern, century)
    fields = F.regexp_replace(F.regexp_replace(text, _SPELLING, _FIELDS), r"/\.(\d{6})\d*/([AaPp]?)", "/.$1/$2M")
    plain = F.regexp_replace(fields, "/M/", "//")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in _FORMATS])


def parse_ts(value: Column) -> Column:
    """Epoch seconds, an ISO 8601 date or one written by people (UTC unless it names a zone); otherwise null."""
    text = strip(value.cast("string"))
    return F.coalesce(epoch_ts(value.cast("string")), F.try_to_timestamp(text), spelled_ts(text))


def format_ts(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, ISO_MICROS), F.lit(""))


def epoch_seconds(ts: Column) -> Column:
    return F.coalesce(F.unix_seconds(ts), F.lit(0)).cast("bigint")
