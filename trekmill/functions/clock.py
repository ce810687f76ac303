"""Service days and clock arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def service_minutes(text: Column) -> Column:
    """Minutes of "H:MM[:SS]", which may pass 24 hours; null for anything else."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d{1,3}):([0-5]\d)(?::[0-5]\d)?$", i).try_cast("int")
    return part(1) * 60 + part(2)


def service_epoch(day: Column, minutes: Column, zone: str | Column) -> Column:
    """Instant of a service minute: local noon less twelve hours, plus the minutes, so that days of a clock change hold."""
    noon = F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(" 12:00:00"))), zone)
    return noon - F.make_dt_interval(hours=F.lit(12)) + F.make_dt_interval(mins=minutes)


def clock(minutes: Column) -> Column:
    """HH:MM of a service minute on the clock."""
    m = F.pmod(minutes, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def runs_on(first: Column, last: Column, weekdays: Column) -> Column:
    """array of the days from first to last on which a calendar runs; weekdays: array of seven booleans, Monday first."""
    return F.filter(F.sequence(first, last), lambda d: F.get(weekdays, F.weekday(d)))
