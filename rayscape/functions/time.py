"""Time scales, in whole nanoseconds.

Times are LONG columns: values pass 2**53, so no step may go through a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rayscape.constants import DAY, GPS_EPOCH, LEAP_TABLE, SECOND, WEEK


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def floor_div(x: Column, n: int) -> Column:
    """x // n for longs, rounded down; exact."""
    whole = x - F.pmod(x, _long(n))
    return F.call_function("div", whole, _long(n))


def utc_ns(time: Column) -> Column:
    """Unix nanoseconds of a timestamp column, which has microseconds."""
    return F.unix_micros(time.cast("timestamp")) * _long(1000)


def timestamp(ns: Column) -> Column:
    """A timestamp for display; microseconds, rounded down."""
    return F.timestamp_micros(floor_div(ns, 1000))


def leap_seconds(utc: Column) -> Column:
    """Leap seconds between GPS and UTC; NULL before the table begins."""
    out = F.lit(None).cast("int")
    for since, seconds in LEAP_TABLE:
        out = F.when(utc >= _long(since), F.lit(seconds)).otherwise(out)
    return F.when(utc.isNotNull(), out)


def _leap_of_gps(gps: Column, of_utc: bool) -> Column:
    """Leap seconds by GPS time. The inserted second still belongs to the old value, and (``of_utc``) its UTC midnight to the new one."""
    out, before = F.lit(None).cast("int"), None
    for since, seconds in LEAP_TABLE:
        shown = seconds if before is None or not of_utc else before
        out = F.when(gps >= _long(since + shown * SECOND - GPS_EPOCH), F.lit(seconds)).otherwise(out)
        before = seconds
    return F.when(gps.isNotNull(), out)


def leap_seconds_at_gps(gps: Column) -> Column:
    """``leap_seconds(gps_to_utc(gps))``, without going through either."""
    return _leap_of_gps(gps, of_utc=True)


def utc_to_gps(utc: Column) -> Column:
    return utc + leap_seconds(utc).cast("long") * _long(SECOND) - _long(GPS_EPOCH)


def gps_to_utc(gps: Column) -> Column:
    """The inverse; an inserted second falls on the midnight after it."""
    return gps + _long(GPS_EPOCH) - _leap_of_gps(gps, of_utc=False).cast("long") * _long(SECOND)


def gps_to_doy(gps: Column) -> tuple[Column, Column]:
    """(date as YYYYDDD, nanoseconds of the day), on the GPS scale."""
    on_gps = gps + _long(GPS_EPOCH)
    day = F.date_add(F.lit("1970-01-01").cast("date"), floor_div(on_gps, DAY).cast("int"))
    date = F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), F.lpad(F.dayofyear(day).cast("string"), 3, "0"))
    return date, F.pmod(on_gps, _long(DAY))


def doy_to_gps(date: Column, ns: Column) -> Column:
    """GPS time of a YYYYDDD date and nanoseconds of its day; NULL for a date that doesn't exist."""
    year, day = F.substring(date, 1, 4).try_cast("int"), F.substring(date, 5, 3).try_cast("int")
    first = F.when(date.rlike(r"^\d{7}$"), F.make_date(F.when(year >= 1, year), F.lit(1), F.lit(1)))
    days = F.unix_date(first) + day - 1
    real = (day >= 1) & (F.year(F.date_add(first, day - 1)) == year)
    return F.when(real, days.cast("long") * _long(DAY) + ns - _long(GPS_EPOCH))


def gps_to_gpsweek(gps: Column) -> tuple[Column, Column, Column]:
    """(week, day of the week, nanoseconds of the day)."""
    return floor_div(gps, WEEK), floor_div(F.pmod(gps, _long(WEEK)), DAY), F.pmod(gps, _long(DAY))


def gpsweek_to_gps(week: Column, day: Column, ns: Column) -> Column:
    return (week.cast("long") * _long(7) + day.cast("long")) * _long(DAY) + ns
