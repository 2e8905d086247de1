"""Timestamps are RFC 3339 text; days are its first ten characters. "Now" is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"


def day(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of the first 19 characters; fractions and offsets are ignored, other text is null."""
    text = F.replace(F.substring(ts, 1, 19), F.lit("T"), F.lit(" "))
    month = F.try_to_date(F.concat(F.substring(text, 1, 7), F.lit("-01")), "yyyy-MM-dd")
    part = lambda at: F.substring(text, at, 2).try_cast("bigint")
    days = F.datediff(month, F.lit("1970-01-01").cast("date")).cast("bigint") + part(9) - 1  # a day 32 runs on into the next month
    seconds = days * 86400 + part(12) * 3600 + part(15) * 60 + part(18)
    return F.when(ts.rlike(_SHAPE), seconds)


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339_millis(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def days_before(as_of: str, n: int) -> str:
    """The day n days before the day of ``as_of``."""
    return str(dt.date.fromisoformat(as_of[:10]) - dt.timedelta(days=n))


def to_epoch(as_of: str) -> int:
    return int(dt.datetime.fromisoformat(as_of[:19] + "+00:00").timestamp())


def range_preset(name: str, as_of: str) -> tuple[str, str]:
    """First and last day of the dashboard's presets: 7d, 30d, 90d, ytd."""
    last = as_of[:10]
    if name == "ytd":
        return f"{last[:4]}-01-01", last
    return days_before(last, int(name.removesuffix("d")) - 1), last
