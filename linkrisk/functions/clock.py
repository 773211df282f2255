"""Times and durations.  The present is always a parameter, never read here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(when: Column) -> Column:
    """UTC text of a timestamp, to the second; '' for null."""
    return F.coalesce(F.date_format(when, ISO), F.lit(""))


def parse(text: Column) -> Column:
    """Timestamp of ISO text; null where it can't be read."""
    return F.coalesce(F.try_to_timestamp(text, F.lit(ISO)), F.try_to_timestamp(text))


def local(when: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(when, zone), "yyyy-MM-dd HH:mm"), F.lit(""))


def ago(now: Column, *, days: float = 0, hours: float = 0) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400 + hours * 3600))


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds in Korean, leaving out what is zero; '-' for none."""
    s = F.floor(seconds).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(F.floor(s / 3600), "시간"), part(F.floor(s / 60) % 60, "분"), part(s % 60, "초"))
    return F.when(seconds.isNull() | (seconds < 0), F.lit("-")).when(text == "", F.lit("0초")).otherwise(text)
