"""UTC time expressions. Operators take ``as_of`` rather than reading the clock."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col, strip


def parse_utc(iso: ColumnOrName) -> Column:
    """ISO text with ``Z``, an offset or no zone (UTC); null where it is not a time."""
    return F.try_to_timestamp(strip(iso))


def as_timestamp(as_of: datetime | str) -> Column:
    if isinstance(as_of, datetime):
        if as_of.tzinfo is None:
            as_of = as_of.replace(tzinfo=timezone.utc)
        as_of = as_of.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f") + "Z"
    return F.lit(as_of).cast("timestamp")


def within_hours(ts: ColumnOrName, as_of: datetime | str, hours: float) -> Column:
    age = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(col(ts))
    return F.coalesce(age <= F.lit(int(hours * 3_600_000_000)), F.lit(False))


def utc_day(ts: ColumnOrName) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def iso_utc(ts: ColumnOrName) -> Column:
    return F.date_format(F.to_utc_timestamp(col(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def report_time(ts: ColumnOrName) -> Column:
    """Wall time in the session zone with the zone's name; UTC is shown as an offset."""
    wall = F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")
    zone = F.date_format(col(ts), "z")
    return F.concat(wall, F.when(zone == "UTC", F.lit(" (UTC+00:00)")).otherwise(F.concat(F.lit(" "), zone)))


def in_period(ts: ColumnOrName, as_of: datetime | str, cadence: str = "weekly") -> Column:
    """Same calendar month as ``as_of`` for ``monthly``, same ISO week otherwise."""
    ts, now = col(ts), as_timestamp(as_of)
    if cadence.strip().lower() == "monthly":
        return F.coalesce(F.trunc(ts, "month") == F.trunc(now, "month"), F.lit(False))
    return F.coalesce(F.trunc(ts, "week") == F.trunc(now, "week"), F.lit(False))
