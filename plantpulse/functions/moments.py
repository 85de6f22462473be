"""Zone-free helpers for ``timestamp_ntz`` columns.

``date_trunc`` and ``timestampdiff`` go through the session time zone; the
helpers here only use calendar fields, so a result never depends on it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def as_moment(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def moment(value: datetime | str) -> Column:
    """A literal the optimizer folds, so that comparisons reach the parquet scan."""
    return F.lit(as_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def between_moments(ts: Column, start: datetime, end: datetime) -> Column:
    return (ts >= moment(start)) & (ts <= moment(end))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, fractions dropped."""
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def hour_floor(ts: Column) -> Column:
    return day_floor(ts) + F.make_dt_interval(F.lit(0), F.hour(ts))


def day_floor(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def _boundaries(start: Column, end: Column, seconds: int) -> Column:
    """Number of unit boundaries crossed between two moments."""
    return (
        F.floor(epoch_seconds(end) / seconds) - F.floor(epoch_seconds(start) / seconds)
    ).cast("long")


def minutes_between(start: Column, end: Column) -> Column:
    return _boundaries(start, end, 60)


def hours_between(start: Column, end: Column) -> Column:
    return _boundaries(start, end, 3600)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end.cast("date"), start.cast("date")).cast("long")
