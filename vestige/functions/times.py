"""Epochs and time texts. All results are UTC without zone, in microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds from the epoch's start to 1970-01-01.
FILETIME_OFFSET = 11_644_473_600
COCOA_OFFSET = -978_307_200
DOTNET_OFFSET = 62_135_596_800
OLE_OFFSET_DAYS = 25_569
UNIX_LEAST, UNIX_MOST = -11_644_473_600, 253_402_300_799


def micros_of(c: Column) -> Column:
    """Microseconds since 1970 of a time with or without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c.cast("timestamp_ntz"))


def from_micros(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", c.cast("long"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def filetime_micros(ticks: Column) -> Column:
    """100 ns ticks since 1601; 0 is unset."""
    return F.when(ticks != 0, F.floor(ticks / 10).cast("long") - FILETIME_OFFSET * 1_000_000)


def filetime_text(ticks: Column) -> Column:
    """ISO text that keeps the seventh digit."""
    micros = filetime_micros(ticks)
    seconds = F.date_format(from_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros.isNotNull(), F.concat(seconds, F.lit("."), F.lpad((ticks % 10_000_000).cast("string"), 7, "0"), F.lit("Z")))


def webkit_micros(c: Column) -> Column:
    return F.when(c > 0, c.cast("long") - FILETIME_OFFSET * 1_000_000)


def prtime_micros(c: Column) -> Column:
    return F.when(c != 0, c.cast("long"))


def unix_micros(c: Column) -> Column:
    return F.when(c.between(UNIX_LEAST, UNIX_MOST), c.cast("long") * 1_000_000)


def unix_ms_micros(c: Column) -> Column:
    return F.when(c != 0, c.cast("long") * 1000)


def cocoa_micros(seconds: Column) -> Column:
    return seconds.cast("long") * 1_000_000 - COCOA_OFFSET * 1_000_000


def cocoa_ns_micros(ns: Column) -> Column:
    return F.floor(ns / 1000).cast("long") - COCOA_OFFSET * 1_000_000


def dotnet_micros(ticks: Column) -> Column:
    return F.floor(ticks / 10).cast("long") - DOTNET_OFFSET * 1_000_000


def ole_micros(days: Column) -> Column:
    return F.round((days - OLE_OFFSET_DAYS) * 86_400_000_000).cast("long")


def hour_boundaries(a: Column, b: Column) -> Column:
    """How many full hours begin after ``a`` and not after ``b``: boundaries, not elapsed time."""
    hour = lambda c: F.floor(micros_of(c) / 3_600_000_000).cast("long")
    return hour(b) - hour(a)


def day_boundaries(a: Column, b: Column) -> Column:
    return F.datediff(b.cast("date"), a.cast("date")).cast("long")


def span_text(ticks: Column) -> Column:
    """A time span of ticks of 100 ns as ``[-][d.]hh:mm:ss[.fffffff]``."""
    total = F.abs(ticks)
    fraction = F.pmod(total, F.lit(10_000_000))
    seconds = F.round((total - fraction) / 10_000_000).cast("long")  # whole, but for the rounding of large numbers
    days = F.floor(seconds / 86_400).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds % 86_400 / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), seconds % 60)
    return F.concat(
        F.when(ticks < 0, F.lit("-")).otherwise(F.lit("")),
        F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit("")),
        clock,
        F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 7, "0"))).otherwise(F.lit("")),
    )


def timespan_text(micros: Column) -> Column:
    return span_text(micros * 10)


def duration_text(start: Column, end: Column) -> Column:
    """The span between two file times; empty where either was never set."""
    return F.when((start > 0) & (end > 0), span_text(end - start)).otherwise("")


def utc_text(c: Column) -> Column:
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_time(text: Column) -> Column:
    """A full date at least; a bare year isn't a time, and another offset than Z isn't UTC."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z?)?$"
    return F.when(text.rlike(shape), F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz"))


def in_hours(minute_of_day: Column, start: int, end: int) -> Column:
    """Whether a minute lies in a window of the day that may go over midnight."""
    return minute_of_day.between(start, end - 1) if start <= end else (minute_of_day >= start) | (minute_of_day < end)


def timestomp_flags(standard: list[str], named: list[str]) -> dict[str, Column]:
    """Flags of a file record from its ticks of 100 ns, created and modified first (further times may follow, in one order).

    ``timestomped``: the name's creation is later than the standard one.
    ``usec_zeros``: created and modified are whole seconds. ``copied``: all times
    are equal. A missing time counts as 0, as the record holds it.
    """
    si, fn = ([F.coalesce(F.col(c), F.lit(0)) for c in cs] for cs in (standard, named))
    copied = F.lit(True)
    for a, b in zip(si, fn):
        copied = copied & (a == b)
    return {"timestomped": fn[0] > si[0], "usec_zeros": (si[0] % 10_000_000 == 0) & (si[1] % 10_000_000 == 0), "copied": copied}


def in_zone_text(at: Column, zone: str) -> Column:
    """A UTC time as ``<local> <offset>`` of a zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at)
    minutes = F.timestamp_diff("MINUTE", at, local)
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), offset)


# Names of UTC, for which the offset is shown as Z.
UTC_NAMES = ["UTC", "Etc/UTC", "Etc/UCT", "Etc/Universal", "Etc/Zulu", "UCT", "Universal", "Zulu"]


def rendered(text: Column, zone: str) -> Column:
    """UTC text (``2024-01-31T10:00:00.2040000Z``) as a struct (local, offset) of a zone: the fraction stays as it is written.

    Null for any other text, or where the local year has more than four digits.
    """
    shape = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})((?:\.\d{1,9})?)Z\z"
    at = F.concat(F.regexp_extract(text, shape, 1), F.lit(" "), F.regexp_extract(text, shape, 2)).try_cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at)
    seconds = F.timestamp_diff("SECOND", at, local)
    part = lambda of, by: F.floor(F.abs(seconds) % of / by).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(seconds < 0, "-").otherwise("+"), part(1 << 30, 3600), part(3600, 60))
    offset = F.when(part(60, 1) > 0, F.concat(offset, F.format_string(":%02d", part(60, 1)))).otherwise(offset)
    shown = F.struct(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.regexp_extract(text, shape, 3)).alias("local"), (F.lit("Z") if zone in UTC_NAMES else offset).alias("offset"))
    return F.when(F.year(local).between(0, 9999), shown)


def wall_to_utc(wall: Column, zone: str) -> Column:
    """A wall-clock time of a zone as UTC; null for times that a clock change skips or repeats."""
    there = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    hour = F.expr("INTERVAL 1 HOUR")
    repeated = (there(utc + hour) == wall) | (there(utc - hour) == wall)
    return F.when((there(utc) == wall) & ~repeated, utc)


def differing(named: Column, standard: Column) -> Column:
    """A file name's time, null where it is the same as the standard one."""
    return F.when(~named.eqNullSafe(standard), named)
