"""Local time as column expressions: fixed UTC+6, weekend Friday and Saturday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "+06:00"


def local(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def minute_of_day(ts: Column) -> Column:
    here = local(ts)
    return F.hour(here) * 60 + F.minute(here)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(local(ts))


def weekend(ts: Column) -> Column:
    return F.weekday(local(ts)).isin(4, 5)


def time_features(minute: Column, is_weekend: Column) -> Column:
    """A place on the day's circle, with weekends apart."""
    turn = minute * (2.0 * 3.141592653589793 / 1440.0)
    return F.array(F.sin(turn), F.cos(turn), is_weekend.cast("int") * 3.0)


def capture_time(name: Column) -> Column:
    """'city-2026-09-17T0841Z' as a timestamp; null if there is no time in it."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}T\d{4})Z", 1), F.lit("yyyy-MM-dd'T'HHmm"))


def capture_name(ts: Column, prefix: str = "dhaka") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(ts, "yyyy-MM-dd'T'HHmm"), F.lit("Z"))


def hour_label(hour: Column) -> Column:
    return F.concat((F.pmod(hour + 11, F.lit(12)) + 1).cast("string"), F.when(hour < 12, " am").otherwise(" pm"))


def time_label(ts: Column) -> Column:
    return F.date_format(local(ts), "EEEE hh:mm a")


def day_label(ts: Column) -> Column:
    return F.date_format(local(ts), "EEE d MMM")


def day_start(ts: Column) -> Column:
    """Local midnight, in UTC."""
    return F.to_utc_timestamp(F.date_trunc("day", local(ts)), ZONE)


def circular_gap(a: Column, b: Column) -> Column:
    """Minutes between two times of day, the short way round."""
    d = F.abs(a - b)
    return F.least(d, 1440 - d)


def target_time(day: Column, clock: Column) -> Column:
    """Weekday name and 'HH:MM' in the week of Monday 2026-09-21, in UTC."""
    names = F.array(*[F.lit(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    date = F.date_add(F.lit("2026-09-21").cast("date"), (F.array_position(names, F.lower(day)) - 1).cast("int"))
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date.cast("string"), clock), "yyyy-MM-dd HH:mm"), ZONE)
