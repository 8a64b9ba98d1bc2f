"""Parsing of dates and times, and windows of time. All in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"
LOCAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?$"


def strict(text: Column) -> Column:
    """A date and time with an offset; null for any other text."""
    return F.when(text.rlike(OFFSET), text.try_cast("timestamp"))


def lenient(text: Column) -> Column:
    """With an offset, or without one as UTC; null for any other text."""
    return F.coalesce(strict(text), F.when(text.rlike(LOCAL), F.concat(text, F.lit("Z")).try_cast("timestamp")))


def http_date(text: Column) -> Column:
    """``Sun, 06 Nov 1994 08:49:37 GMT``; the day's name is not checked."""
    return F.when(text.rlike(r"^[A-Z][a-z]{2}, [0-9]{2} "), F.try_to_timestamp(F.regexp_replace(F.substr(text, F.lit(6)), "GMT$", "UTC"), F.lit("dd MMM yyyy HH:mm:ss VV")))


def midpoint(a: Column, b: Column) -> Column:
    return F.timestamp_micros(F.floor((F.unix_micros(a) + F.unix_micros(b)) / 2).cast("long"))


def month_path(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM")


def is_stale(last: Column, now: Column, days: Column | int) -> Column:
    """Never refreshed, or longer ago than so many days."""
    limit = F.lit(days) if isinstance(days, int) else days
    return last.isNull() | (F.unix_micros(now) - F.unix_micros(last) > limit.cast("long") * 86_400_000_000)
