"""Capture times: the wall clock for filters and calendars, the instant for distances."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATED = r"^\d{4}-\d{2}-\d{2}"


def wall_clock(captured_at: Column) -> Column:
    """The local date and time of an ISO string, any offset dropped; null if it does not parse."""
    return F.when(captured_at.rlike(_DATED), captured_at.try_cast("timestamp_ntz"))


def epoch_seconds(captured_at: Column) -> Column:
    """The instant of an ISO string in seconds; without an offset it is read in the session's time zone."""
    return F.when(captured_at.rlike(_DATED), F.unix_micros(captured_at.try_cast("timestamp")) / 1e6)


def trusted(source: Column, epoch: Column) -> Column:
    """Only camera metadata vouches for a capture time."""
    return F.coalesce(source == "exif", F.lit(False)) & epoch.isNotNull()


def exif_time(text: Column) -> Column:
    """The two spellings that cameras write, with / read as :, as a wall clock."""
    clean = F.regexp_replace(F.trim(text), "/", ":")
    return F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(clean, "-", ":"), F.lit("yyyy:MM:dd HH:mm:ss")))


def in_window(wall: Column, start: datetime | date | None, end: datetime | date | None) -> Column:
    """start <= wall < end, each side optional; a null time is not inside (null, which no filter passes)."""
    out = wall.isNotNull()
    if start is not None:
        out &= wall >= F.lit(str(start)).cast("timestamp_ntz")
    if end is not None:
        out &= wall < F.lit(str(end)).cast("timestamp_ntz")
    return out
