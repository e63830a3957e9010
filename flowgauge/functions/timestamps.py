"""Event-time expressions. At rest a time is TIMESTAMP_NTZ in UTC; watermarks need TIMESTAMP."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The time format of messages; a whole second has no fraction.
ISO_WITH_OFFSET = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
ISO_WHOLE_SECOND = "yyyy-MM-dd'T'HH:mm:ssxxx"
MINUTE_LABEL = "yyyy-MM-dd HH:mm"


def zoned(when: Column) -> Column:
    """Instant of a stored time, as watermarks require."""
    return when.cast("timestamp")


def zoneless(when: Column) -> Column:
    """Stored form of an instant; the session zone must be UTC."""
    return when.cast("timestamp_ntz")


def from_iso(text: Column) -> Column:
    """Instant of an ISO-8601 text with offset, NULL when the text is no time."""
    return F.try_to_timestamp(text)


def to_iso(when: Column) -> Column:
    """ISO-8601 text with offset, and with microseconds unless they are 0."""
    instant = zoned(when)
    whole = F.date_trunc("second", instant) == instant
    text = F.date_format(instant, ISO_WITH_OFFSET)
    return F.when(whole, F.date_format(instant, ISO_WHOLE_SECOND)).otherwise(text)


def hour_of(when: Column) -> Column:
    """Start of the hour; date_trunc answers with a zoned type, so the stored form is restored."""
    return zoneless(F.date_trunc("hour", when))


def minute_label(when: Column) -> Column:
    return F.date_format(when, MINUTE_LABEL)


def literal_time(when: datetime) -> Column:
    """Zone-less literal. F.lit would shift a naive datetime through the Python process's zone."""
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def literal_date(when: datetime) -> Column:
    return F.lit(when.date().isoformat()).cast("date")
