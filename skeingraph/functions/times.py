"""Moments as text and numbers, in universal time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(ts: Column) -> Column:
    """The session's moment as the clock reads in universal time, whatever the session's zone."""
    return F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def iso(ts: Column) -> Column:
    """As 2024-01-31T05:06:07.000008+00:00."""
    return F.date_format(utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def saved_name(ts: Column, stem: str) -> Column:
    """Name of a file that was saved at a moment."""
    return F.concat(F.lit(f"{stem}-"), F.date_format(utc(ts), "yyyyMMdd-HHmmss"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def age(ts: Column, now: Column) -> Column:
    """In words: the largest whole unit of days, hours, minutes and seconds; what is yet to come is new."""
    s = F.floor(epoch_seconds(now) - epoch_seconds(ts))
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, " ago").otherwise("s ago"))
    return F.when(s >= 86400, said(F.floor(s / 86400), "day")).when(s >= 3600, said(F.floor(s / 3600), "hour")).when(s >= 60, said(F.floor(s / 60), "minute")).when(s > 0, said(s, "second")).otherwise("now")
