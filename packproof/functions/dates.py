"""Dates and relative times; every function takes its "now" (FN-24, FN-25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expiry_status(date: Column, as_of: Column) -> Column:
    """EXPIRED before ``as_of``, ``Expires in Nd`` within 60 days, else (also if unreadable) Active Batch."""
    days = F.datediff(F.try_to_date(date, "yyyy-MM-dd"), as_of)
    return F.when(days < 0, "EXPIRED").when(days <= 60, F.concat(F.lit("Expires in "), days.cast("string"), F.lit("d"))).otherwise("Active Batch")


def parse_ts(text: Column) -> Column:
    """Epoch milliseconds, ISO or space form; anything else is null."""
    millis = F.when(text.rlike("^[0-9]{12,14}$"), F.timestamp_millis(text.try_cast("long")))
    return F.coalesce(millis, text.try_cast("timestamp"))


def relative_time(ts: Column, as_of: Column) -> Column:
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(ts.isNull(), "Unknown").when(seconds < 60, "Just now").when(seconds < 3600, whole(60, "m ago")).when(seconds < 86400, whole(3600, "h ago")).when(seconds < 7 * 86400, whole(86400, "d ago")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
