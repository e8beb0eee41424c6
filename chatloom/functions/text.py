"""Column expressions that rebuild and clean message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: ISO 8601 date with optional time, fraction and zone.
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)


# The basic form of the same dates, without separators.
BASIC_TIMESTAMP = (
    r"^(\d{4})(\d{2})(\d{2})"
    r"(?:[T ](\d{2})(?:(\d{2})(?:(\d{2})(\.\d{1,9})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_text(text: Column) -> Column:
    """Strip the ends, then turn the remaining newlines into spaces."""
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def message_text(entities: Column, sticker: Column) -> Column:
    """Entity texts in order, followed by the sticker emoji."""
    return F.concat(
        F.coalesce(F.array_join(entities["text"], ""), F.lit("")),
        F.coalesce(sticker, F.lit("")),
    )


def parse_timestamp(text: Column) -> Column:
    """ISO text to TIMESTAMP_NTZ (wall clock, zone suffix ignored), else NULL."""
    # Basic form: the digits, missing ones of the time as zeros, spelled out.
    digits = F.rpad(F.regexp_replace(text, BASIC_TIMESTAMP, "$1$2$3$4$5$6"), 14, "0")
    spelled = F.concat(
        F.regexp_replace(digits, r"^(.{4})(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6"),
        F.regexp_extract(text, BASIC_TIMESTAMP, 7),
    )
    return F.when(text.rlike(ISO_TIMESTAMP), text.try_cast("timestamp_ntz")).when(
        text.rlike(BASIC_TIMESTAMP), spelled.try_cast("timestamp_ntz")
    )


def iso_format(ts: Column) -> Column:
    """ISO 8601 text; microseconds only when they are not zero.

    Goes through the plain cast, which unlike ``date_format`` is independent of
    the session time zone.
    """
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def is_given(text: Column) -> Column:
    """Neither NULL nor empty, in a form that a Parquet scan can use."""
    return text.isNotNull() & (text != "")


def micros_between(start: Column, end: Column) -> Column:
    """Wall-clock microseconds between two TIMESTAMP_NTZ, whatever the session zone."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")
