"""Time parsing, bucketing and window-width strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "min": 60, "m": 60, "t": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
}


def width_seconds(width: str) -> int:
    """Seconds of a width such as ``"30s"``, ``"60s"``, ``"5min"`` or ``"1 hour"``."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", width)
    if not m or m.group(2).lower() not in _UNITS or int(m.group(1)) == 0:
        raise ValueError(f"not a window width: {width!r}")
    return int(m.group(1)) * _UNITS[m.group(2).lower()]


def floor_bucket(ts: Column, width: str) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts`` (TIMESTAMP_NTZ in and out).

    A plain scalar expression; ``F.window`` may stand only once in a plan node.
    """
    sec = width_seconds(width)
    epoch = F.unix_seconds(ts.cast("timestamp"))
    floored = F.floor(epoch / F.lit(sec)) * F.lit(sec)
    return F.timestamp_seconds(floored).cast("timestamp_ntz")


def general_timestamp(text: Column) -> Column:
    """Parse text that carries its own date; null where it does not."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def syslog_timestamp(text: Column, year: int) -> Column:
    """Parse ``Mon d HH:MM:SS`` under a year given by the caller."""
    squeezed = F.regexp_replace(F.trim(text), r"\s+", " ")
    dated = F.concat(squeezed, F.lit(f" {year}"))
    return F.try_to_timestamp(dated, F.lit("MMM d HH:mm:ss yyyy")).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
