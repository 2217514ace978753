"""Calendar arithmetic on zone-free timestamps.

``date_trunc`` converts to the session zone first, so hour and week floors are built from
date parts instead: the result is the same in every session zone.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday names shown to users, Monday first.
WEEKDAY_NAMES = ["Thứ 2", "Thứ 3", "Thứ 4", "Thứ 5", "Thứ 6", "Thứ 7", "Chủ nhật"]

_ZONE_SUFFIX = r"(?i)(Z|UTC|[+-]\d{2}(:?\d{2})?)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock(value: Column | str | dt.datetime | dt.date) -> Column:
    """A zone-free timestamp literal; a zoned value is converted to UTC first."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(str(value)).cast("timestamp_ntz")


def day(value: Column | str | dt.date) -> Column:
    """A date literal, or a date column."""
    return value.cast("date") if isinstance(value, Column) else F.lit(str(value)).cast("date")


def instant_to_utc(ts: Column) -> Column:
    """A zoned timestamp as its UTC clock reading, whatever the session zone is."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse_utc(text: Column | str) -> Column:
    """Text to a UTC clock reading; a text without zone is UTC, a bad one is null."""
    c = F.trim(col(text))
    zoned = (F.length(c) > 10) & c.rlike(_ZONE_SUFFIX)
    return F.when(zoned, instant_to_utc(c.try_cast("timestamp"))).otherwise(
        c.try_cast("timestamp_ntz")
    )


def number(c: Column | str) -> Column:
    """A count as double; bad text and NaN become null."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def day_floor(ts: Column | str) -> Column:
    return F.to_date(col(ts)).cast("timestamp_ntz")


def hour_floor(ts: Column | str) -> Column:
    ts = col(ts)
    return day_floor(ts) + F.make_dt_interval(hours=F.hour(ts))


def slot_floor(ts: Column | str, minutes: int = 30) -> Column:
    """Start of the slot of ``minutes`` (a divisor of 60) that holds ``ts``."""
    ts = col(ts)
    past = F.minute(ts) - F.minute(ts) % F.lit(minutes)
    return hour_floor(ts) + F.make_dt_interval(mins=past)


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return col(ts) + F.make_dt_interval(hours=hours.cast("int"))


def hour_number(ts: Column | str) -> Column:
    """Hours since 1970 as an integer."""
    ts = col(ts)
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def hours_between(earlier: Column | str, later: Column | str) -> Column:
    """Whole hours from one hour mark to a later one."""
    a, b = col(earlier), col(later)
    return F.datediff(F.to_date(b), F.to_date(a)) * 24 + F.hour(b) - F.hour(a)


def week_start(d: Column | str) -> Column:
    """Monday of the week."""
    d = F.to_date(col(d))
    return F.date_sub(d, F.weekday(d))


def month_start(d: Column | str) -> Column:
    return F.trunc(F.to_date(col(d)), "month")


def last_microsecond(d: Column) -> Column:
    """The end of a day at Spark's resolution."""
    return F.date_add(d, 1).cast("timestamp_ntz") - F.make_dt_interval(
        secs=F.lit("0.000001").cast("decimal(18,6)")
    )


def _cycle(position: Column, period: float, name: str) -> list[Column]:
    angle = position * F.lit(2 * math.pi) / F.lit(float(period))
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def hour_week_features(ts: Column | str) -> list[Column]:
    """Position in the day (by hour) and in the week, each as sine and cosine."""
    ts = col(ts)
    return _cycle(F.hour(ts), 24, "hour") + _cycle(F.weekday(ts), 7, "dow")


def minute_week_features(ts: Column | str) -> list[Column]:
    """Position in the day (by minute) and in the week, each as sine and cosine."""
    ts = col(ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return _cycle(minute, 24 * 60, "time") + _cycle(F.weekday(ts), 7, "week")


def period_timestamp(date: Column | str, period: Column | str) -> Column:
    """Slot time from a date and a text such as ``period_7_30``; null when it does not parse."""
    period = col(period)
    pattern = r"period_(\d+)_(\d+)"
    hours = F.regexp_extract(period, pattern, 1).try_cast("int")
    minutes = F.regexp_extract(period, pattern, 2).try_cast("int")
    return col(date).try_cast("date").cast("timestamp_ntz") + F.make_dt_interval(
        hours=hours, mins=minutes
    )


def numbered_period_timestamp(
    date: Column | str, period: Column | str, minutes: int = 30
) -> Column:
    """Slot time from a date and a slot number that starts at 1."""
    slot = F.floor(col(period).try_cast("double")).cast("int")
    return col(date).try_cast("date").cast("timestamp_ntz") + F.make_dt_interval(
        mins=(slot - 1) * minutes
    )


def weekday_name(ts: Column | str) -> Column:
    names = F.array(*[F.lit(name) for name in WEEKDAY_NAMES])
    return F.element_at(names, F.weekday(col(ts)) + 1)


def weekday_day_label(ts: Column | str) -> Column:
    """Weekday name and day, for example ``Thứ 2 01/01``."""
    return F.concat_ws(" ", weekday_name(ts), F.date_format(col(ts), "dd/MM"))


def time_label(hour: Column | str, minute: Column | str) -> Column:
    """``HH:MM`` from two integers."""
    parts = [F.lpad(col(c).cast("string"), 2, "0") for c in (hour, minute)]
    return F.concat_ws(":", *parts)


def range_label(start: Column | str, end: Column | str) -> Column:
    return F.concat(
        F.date_format(col(start), "yyyy-MM-dd"), F.lit(" → "), F.date_format(col(end), "yyyy-MM-dd")
    )


def local_clock(utc_now: Column | str, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """The wall clock of ``zone`` at a UTC clock reading."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), clock(utc_now))


def next_slots(now: Column, steps: int = 4, minutes: int = 30) -> Column:
    """Array of the slot starts that follow the slot holding ``now``."""
    current = slot_floor(now, minutes)
    return F.transform(
        F.sequence(F.lit(1), F.lit(steps)),
        lambda i: current + F.make_dt_interval(mins=(i * minutes).cast("int")),
    )


def shift_to_week_of(ts: Column | str, today: Column | str | dt.date) -> Column:
    """Same weekday and time on the first matching day at or after ``today``."""
    ts, today = col(ts), day(today)
    ahead = F.pmod(F.weekday(ts) - F.weekday(today), F.lit(7))
    return F.date_add(today, ahead).cast("timestamp_ntz") + (ts - day_floor(ts))


def calendar_columns(df: DataFrame, ts: str = "DateTime") -> DataFrame:
    """Year, month, date, hour and day columns used by rollups."""
    c = F.col(ts)
    return df.withColumns(
        {
            "Year": F.year(c),
            "Month": F.month(c),
            "Date": F.to_date(c),
            "Hour": F.hour(c),
            "Day": F.dayofmonth(c),
            "DayOfWeek": F.weekday(c),
            "HourOfDay": F.hour(c),
        }
    )
