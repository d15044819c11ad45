"""Date and time column helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col_of

# Day-first export format, one-digit day/month/hour accepted.
DMY_HM_FORMAT = "d/M/yyyy H:mm"
YYYYMMDD_FORMAT = "yyyyMMdd"


def as_date_literal(d) -> Column:
    if isinstance(d, str):
        d = dt.date.fromisoformat(d[:10])
    if isinstance(d, dt.datetime):
        d = d.date()
    return F.lit(d)


def as_ts_literal(ts) -> Column:
    """A naive (NTZ) timestamp literal; dates become midnight."""
    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    if isinstance(ts, dt.date) and not isinstance(ts, dt.datetime):
        ts = dt.datetime(ts.year, ts.month, ts.day)
    return F.lit(ts.replace(tzinfo=None)).cast(T.TimestampNTZType())


def parse_yyyymmdd(c, strict: bool = False) -> Column:
    """``YYYYMMDD`` (string or integer) -> DATE; lenient mode yields null on bad input."""
    s = col_of(c).cast("string")
    if strict:
        return F.to_date(s, YYYYMMDD_FORMAT)
    return F.try_to_date(s, YYYYMMDD_FORMAT)


def parse_dmy_hm(c) -> Column:
    """``d/M/yyyy H:mm`` -> naive timestamp; unparseable -> null."""
    return F.try_to_timestamp(col_of(c), F.lit(DMY_HM_FORMAT)).cast(T.TimestampNTZType())


def parse_iso_timestamp(c) -> Column:
    """ISO date or timestamp text -> naive UTC timestamp; null and blank stay null, any other
    text that is no timestamp fails the job."""
    c = col_of(c).cast("string")
    return F.to_timestamp(F.when(F.trim(c) != "", c)).cast(T.TimestampNTZType())


def to_naive_timestamp(c, dtype: T.DataType | None = None) -> Column:
    """Coerce to a naive UTC timestamp, null when the value cannot be read."""
    c = col_of(c)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast(T.TimestampNTZType())
    return F.try_to_timestamp(c.cast("string")).cast(T.TimestampNTZType())


def whole_days_between(start, end) -> Column:
    """Whole elapsed 24-hour days (``Timedelta.days`` for end >= start)."""
    return F.timestamp_diff("DAY", col_of(start), col_of(end))
