"""Text that stands for spans of time: freshness targets, retention, relative dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# --- fixed values --------------------------------------------------------------------------
SLA_DEFAULT_MINUTES = 1440
SLA_DEFAULT_TEXT = "1d"
MINUTES_PER_UNIT = {"m": 1, "h": 60, "d": 1440, "y": 525960}
RETENTION_DEFAULT_DAYS = 7
RETENTION_DEFAULT_TEXT = "7 days (default — not explicitly set)"
RETENTION_PATTERN = r"(?i)(\d+)\s*day"
# -------------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(moment: dt.datetime, kind: str = "timestamp_ntz") -> Column:
    """A moment as a literal of the given timestamp type, read as the session's wall clock whatever
    the time zone of the Python process."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind)


def sla_minutes(c) -> Column:
    """``30m``, ``4h``, ``7d``, ``1y`` to minutes; anything else, NULL included, to one day."""
    text = F.lower(F.trim(_col(c)))
    number = F.regexp_extract(text, r"^([+-]?\d+)\s*[mhdy]$", 1).try_cast("int")
    unit = F.right(text, F.lit(1))
    factor = F.when(unit == "m", MINUTES_PER_UNIT["m"])
    for name in ("h", "d", "y"):
        factor = factor.when(unit == name, MINUTES_PER_UNIT[name])
    return F.coalesce((number.cast("bigint") * factor).try_cast("int"), F.lit(SLA_DEFAULT_MINUTES))


def retention_days(c) -> Column:
    """Days in a retention text such as ``interval 7 days``; only days are understood, else 7."""
    found = F.regexp_extract(_col(c), RETENTION_PATTERN, 1).try_cast("int")
    return F.coalesce(found, F.lit(RETENTION_DEFAULT_DAYS))


def retention_text(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) > 0, c).otherwise(F.lit(RETENTION_DEFAULT_TEXT))


def whole_minutes_between(start, end) -> Column:
    """Whole minutes from ``start`` to ``end``, truncated towards zero."""
    return F.timestamp_diff("MINUTE", _col(start), _col(end))


def whole_days_between(start, end) -> Column:
    """Whole days of 86,400 seconds, rounded down."""
    seconds = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return F.floor(seconds / F.lit(86_400_000_000))


def relative_time(c, as_of) -> Column:
    """``today``, ``yesterday``, ``3 days ago`` … as seen from ``as_of``; the future counts as today."""
    c = _col(c)
    days = F.greatest(whole_days_between(c, as_of), F.lit(0))

    def ago(divisor: int, unit: str) -> Column:
        return F.concat(F.floor(days / divisor).cast("string"), F.lit(f" {unit} ago"))

    return (
        F.when(c.isNull(), F.lit("unknown"))
        .when(days == 0, F.lit("today"))
        .when(days == 1, F.lit("yesterday"))
        .when(days < 7, ago(1, "days"))
        .when(days < 14, F.lit("last week"))
        .when(days < 30, ago(7, "weeks"))
        .when(days < 60, F.lit("last month"))
        .otherwise(ago(30, "months"))
    )
