"""Timestamps as columns: vendor normalisation, week numbers, durations, windows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def vendor_timestamp(text: Column) -> tuple[Column, Column]:
    """(timestamp or null, naive flag) of epoch milliseconds or ISO text.

    Text without a zone has no instant: null, with the flag set.
    """
    trimmed = F.trim(text)
    millis = trimmed.rlike(r"^\d{1,15}$")
    zoned = trimmed.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & trimmed.contains(":")
    naive = ~millis & ~zoned & F.try_to_timestamp(trimmed).isNotNull()
    value = F.when(millis, F.timestamp_millis(trimmed.try_cast("bigint"))).when(zoned, F.try_to_timestamp(trimmed))
    return value, naive


def week_of_year(ts: Column) -> Column:
    """Monday-first week number as text; days before the first Monday are week 00."""
    weekday = F.weekday(ts)  # Monday is 0
    week = F.floor((F.dayofyear(ts) + 6 - weekday) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end; negative spans are null."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(seconds >= 0, seconds)


def recency_weight(ts: Column, now: Column) -> Column:
    """1 / (1 + age in days); 0.01 where the time is unknown."""
    age = F.greatest((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400.0, F.lit(0.0))
    return F.when(ts.isNull(), 0.01).otherwise(1.0 / (1.0 + age))


def age_label(ts: Column, now: Column) -> Column:
    days = F.datediff(F.to_date(now), F.to_date(ts))
    return F.when(ts.isNull(), "unknown").when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def lower_bound(since: str, now: datetime | None = None) -> datetime:
    """The instant that ``Nd``, ``Nh``, ``Nm``, ``today`` or ``thisweek`` means, in UTC."""
    now = now or datetime.now(timezone.utc)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if since == "today":
        return midnight
    if since == "thisweek":
        return midnight - timedelta(days=now.weekday())
    found = re.fullmatch(r"(\d+)([dhm])", since)
    if not found or int(found[1]) == 0:
        raise ValueError(f"unknown time window: {since!r}")
    unit = {"d": "days", "h": "hours", "m": "minutes"}[found[2]]
    return now - timedelta(**{unit: int(found[1])})
