"""Column functions on names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_type_key(col: Column) -> Column:
    """An event type trimmed and in lower case, with ``-`` and blanks inside turned into ``_``."""
    return F.regexp_replace(F.lower(F.trim(col)), "[- ]", "_")


def letters_key(col: Column) -> Column:
    """The letters a-z of a label in lower case; every other character is dropped."""
    return F.lower(F.regexp_replace(col, "[^A-Za-z]", ""))


def to_ms(col: Column) -> Column:
    """Epoch seconds as whole milliseconds; NULL for NULL, NaN and infinite values."""
    finite = col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(9.0e15))
    return F.when(finite, F.round(col * F.lit(1000.0)).cast("bigint"))


def mask(secret: Column, shown: int = 4) -> Column:
    """The first and last characters of a secret, with stars between; one that is too short is all stars."""
    n = F.length(secret)
    ends = F.concat(F.substring(secret, 1, shown), F.repeat(F.lit("*"), n - 2 * shown), F.right(secret, F.lit(shown)))
    return F.when(n <= 2 * shown, F.repeat(F.lit("*"), n)).otherwise(ends)


def hundredths(col: Column) -> Column:
    """A number of at least 0 with two digits after the point, halves upwards."""
    n = F.floor(col * 100 + F.lit(0.5))
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def one_decimal(col: Column) -> Column:
    """A number of at least 0 with one digit after the point, halves upwards."""
    n = F.floor(col * 10 + F.lit(0.5))
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def moment(seconds: Column, pattern: str) -> Column:
    """Epoch seconds as a text in the session's time zone; '-' for NULL and 0."""
    return F.when(seconds.isNull() | (seconds == 0), "-").otherwise(F.date_format(F.timestamp_seconds(F.floor(seconds)), pattern))


def clip_start(day: Column, hhmm: Column) -> Column:
    """Epoch seconds of HH:MM on a day, in the session's time zone."""
    return F.unix_timestamp(F.concat(day.cast("string"), F.lit(" "), hhmm), "yyyy-MM-dd HH:mm").cast("double")
