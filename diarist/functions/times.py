"""Scalar time functions. Every timestamp is a TIMESTAMP_NTZ in the account's local time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per unit, and the first hour of each part of the day.
MICROS = {"mins": 60e6, "hours": 3600e6, "days": 86400e6, "weeks": 604800e6}
DAY_PARTS = [("morning", 5, 11), ("midday", 11, 17), ("evening", 17, 22)]

_DATE_TIME = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}"


def parse_time(text: Column) -> Column:
    """Text to timestamp; null for text that is not a date with a time."""
    return F.when(text.rlike(_DATE_TIME), text.try_cast("timestamp_ntz"))


def apply_offset(time: Column, seconds: Column) -> Column:
    """``time`` moved by ``seconds``; a null offset moves nothing."""
    zero = F.lit(0)
    return time + F.make_dt_interval(zero, zero, zero, F.coalesce(seconds, zero))


def time_diff(later: Column, earlier: Column, unit: str) -> Column:
    """Fractional ``unit`` from ``earlier`` to ``later``."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(MICROS[unit])


def weekday_label(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "E"), F.lit("NA"))


def time_of_day(time: Column) -> Column:
    """Part of the day; every other hour, and no hour at all, is night."""
    hour, label = F.hour(time), F
    for name, first, end in DAY_PARTS:
        label = label.when((hour >= first) & (hour < end), name)
    return label.otherwise("night")


def days_since(time: Column, start: Column) -> Column:
    """Whole days from ``start``, halves to the even day."""
    return F.bround(time_diff(time, start, "days"))
