"""Period and bucket arithmetic on ``received_at``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative periods, bucket widths and the bucket drawn for a period.
PERIODS = {
    "1h": dt.timedelta(hours=1),
    "6h": dt.timedelta(hours=6),
    "24h": dt.timedelta(hours=24),
    "7d": dt.timedelta(days=7),
    "30d": dt.timedelta(days=30),
}
DEFAULT_PERIOD = "24h"
BUCKETS = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}
DEFAULT_BUCKET = "1h"


def parse_instant(value: dt.datetime | str) -> dt.datetime:
    """A UTC datetime; text without an offset is taken as UTC."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        return value.replace(tzinfo=dt.timezone.utc)
    return value.astimezone(dt.timezone.utc)


def instant(value: dt.datetime | str) -> Column:
    """Literal TIMESTAMP that does not depend on the session time zone."""
    moment = parse_instant(value)
    micros = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(
        microseconds=1
    )
    return F.timestamp_micros(F.lit(micros).cast("long"))


def utc_day(col: Column) -> Column:
    """The UTC day of an instant, whatever the session's time zone."""
    seconds = F.unix_seconds(col)
    return F.date_from_unix_date(((seconds - F.pmod(seconds, F.lit(86400))) / 86400).cast("int"))


def since_of(as_of: dt.datetime | str, period: str = DEFAULT_PERIOD) -> dt.datetime:
    """Start of a relative period; an unknown period means 24 hours."""
    return parse_instant(as_of) - PERIODS.get(period, PERIODS[DEFAULT_PERIOD])


def bucket_for(period: str) -> str:
    return {"1h": "5m", "6h": "15m"}.get(period, DEFAULT_BUCKET)


def bucket_width(bucket: str) -> str:
    return BUCKETS.get(bucket, BUCKETS[DEFAULT_BUCKET])


def bucket(col: Column, width: str) -> Column:
    """Start of the tumbling bucket a time falls into."""
    return F.window(col, bucket_width(width)).getField("start")
