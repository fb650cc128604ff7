"""Clock times: schedule text, seconds of day, minutes and interval labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def hms_to_seconds(text: Column) -> Column:
    """Seconds after midnight of HH:MM:SS text; hours may pass 23, bad text is NULL.

    So are numbers beyond a long.
    """
    parts = F.split(text, ":")
    hours, minutes, seconds = (F.get(parts, F.lit(i)).try_cast("bigint") for i in range(3))
    total = F.try_add(
        F.try_add(F.try_multiply(hours, F.lit(3600)), F.try_multiply(minutes, F.lit(60))), seconds
    )
    return F.when(F.size(parts) == 3, total)


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int")


def whole_minutes(seconds: Column) -> Column:
    """Minutes rounded half to even."""
    return F.bround(seconds / F.lit(60.0), 0).cast("long")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def interval_label(start: Column, end: Column) -> Column:
    """'01 Jan 2024 [08:00:00  - 12:00:00]: ', with both dates when they differ."""
    same_day = F.concat(
        F.date_format(start, "dd MMM yyyy '['HH:mm:ss'  '"),
        F.date_format(end, "'- 'HH:mm:ss']: '"),
    )
    two_days = F.concat(
        F.date_format(start, "'['dd MMM yyyy HH:mm:ss'  '"),
        F.date_format(end, "'- 'dd MMM yyyy'  'HH:mm:ss']: '"),
    )
    return F.when(F.to_date(start) == F.to_date(end), same_day).otherwise(two_days)
