"""A histogram whose buckets follow a zone's clock over its offset changes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.functions.times import micros_of
from vestige.operators.aggregates import WIDTHS
from vestige.relation import Relation

# Fixed values, in seconds: the width of a day, of a week, and of what stands for a calendar month.
DAY, WEEK, MONTH = WIDTHS[-3:]
MICROS = 1_000_000
EPOCH = datetime(1970, 1, 1)
#: How far beyond the rows a bucket may reach.
MARGIN = 40 * DAY
#: Instants at which the offset is read, at most.
MOST_READINGS = 200_000


@dataclass(frozen=True)
class ZonedHistogram:
    """``buckets``: bucket (its place, from 0), start_us, label, end_label, n, marked; non-empty ones. ``slots``: places from the first to the last. ``untimed``: rows without a time."""

    buckets: DataFrame
    width: int
    slots: int
    untimed: int


def offset_at(second: int, zone: str) -> int:
    return int(datetime.fromtimestamp(second, timezone.utc).astimezone(ZoneInfo(zone)).utcoffset().total_seconds())


def offset_changes(first: int, last: int, zone: str) -> list[tuple[int, int]]:
    """(second, offset) of a zone from ``first`` on: the offset then, and each change up to ``last``."""
    out = [(first, offset_at(first, zone))]
    step = max(DAY, (last - first) // MOST_READINGS)
    for at in range(first, last, step):
        end = min(at + step, last)
        while offset_at(end, zone) != out[-1][1]:
            low, high = max(at, out[-1][0]), end  # the offset changes behind low, at high at the latest
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset_at(middle, zone) == out[-1][1] else (low, middle)
            out.append((high, offset_at(high, zone)))
    return out


def place_of(wall: int, width: int) -> int:
    """The number of the bucket that a wall-clock second lies in."""
    if width < MONTH:
        return (wall - (4 * DAY if width == WEEK else 0)) // width  # the epoch's first Monday is its fifth day
    day = EPOCH + timedelta(seconds=wall)
    return day.year * 12 + day.month - 1


def histogram(relation: Relation, most: int, zone: str = "UTC", column: str | None = None, condition: Column | None = None, marked: Column | None = None) -> ZonedHistogram:
    """Rows by time: the least width of ``WIDTHS`` with at most ``most`` places, else the widest.

    ``column``: a typed time, the relation's own by default; one that isn't UTC is bucketed as written, with
    zone UTC. Below a day buckets are the same instants everywhere if all offsets of the span are whole widths,
    else they follow the local clock; days, weeks (from Monday) and months are those of the local calendar.
    """
    column = column or relation.time
    if most < 1 or column is None or dict(relation.df.dtypes).get(column) not in ("timestamp", "timestamp_ntz", "date"):
        raise ValueError(f"no histogram of {column} with {most} buckets")
    df = relation.df if condition is None else relation.df.where(condition)
    rows = df.select(micros_of(F.col(column).cast("timestamp_ntz")).alias("us"), (marked if marked is not None else F.lit(False)).alias("marked"))
    span = rows.agg(F.min("us").alias("low"), F.max("us").alias("high"), F.count_if(F.col("us").isNull()).alias("untimed")).first()
    timed = rows.where("us IS NOT NULL")
    if span["low"] is None:
        empty = timed.select(F.lit(0).cast("long").alias("bucket"), F.col("us").alias("start_us"), F.lit("").alias("label"), F.lit("").alias("end_label"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("marked"))
        return ZonedHistogram(empty.limit(0), WIDTHS[0], 0, span["untimed"])
    low, high = span["low"] // MICROS, span["high"] // MICROS
    changes = offset_changes(low - MARGIN, high + MARGIN, zone)
    within = [o for (at, o), (until, _) in zip(changes, [*changes[1:], (high + 2 * MARGIN, 0)]) if until > low and at <= high]
    offset_then = lambda second: max((c for c in changes if c[0] <= second))[1]
    everywhere = {w: w < DAY and all(o % w == 0 for o in within) for w in WIDTHS}

    def places(width: int) -> tuple[int, int]:
        if everywhere[width]:
            return low // width, high // width
        return place_of(low + offset_then(low), width), place_of(high + offset_then(high), width)

    width = next((w for w in WIDTHS if places(w)[1] - places(w)[0] < most), WIDTHS[-1])
    first, last = places(width)

    table = F.array(*[F.struct(F.lit(at * MICROS).alias("at"), F.lit(o * MICROS).alias("offset"), F.lit(until * MICROS if until is not None else (1 << 62)).alias("until"), F.lit(i > 0).alias("later")) for i, ((at, o), until) in enumerate(zip(changes, [c[0] for c in changes[1:]] + [None]))])
    in_force = lambda us: F.get(F.filter(table, lambda c: us < c["until"]), F.lit(0))["offset"]

    def instant(wall: Column) -> Column:
        """The first instant at which the clock reads ``wall`` or later."""
        each = F.transform(table, lambda c: F.when(c["later"] & (wall < c["at"] + c["offset"]), c["at"]).when(wall < c["until"] + c["offset"], wall - c["offset"]))
        return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))

    wall = F.col("us") if everywhere[width] else F.col("us") + in_force(F.col("us"))
    if width < MONTH:
        shift = 4 * DAY * MICROS if width == WEEK else 0
        number = ((wall - shift - F.pmod(wall - shift, F.lit(width * MICROS))) / (width * MICROS)).cast("long")
        key = lambda k: k * (width * MICROS) + shift
    else:
        day = F.timestamp_micros(wall).cast("timestamp_ntz")
        number = (F.year(day) * 12 + F.month(day) - 1).cast("long")
        key = lambda k: micros_of(F.make_timestamp_ntz(F.floor(k / 12).cast("int"), (k % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    counted = timed.groupBy(number.alias("number")).agg(F.count("*").alias("n"), F.count_if("marked").alias("marked"))
    start, following = (key(F.col("number") + k) if everywhere[width] else instant(key(F.col("number") + k)) for k in (0, 1))
    bounds = counted.withColumns({"start_us": start, "next_us": following})
    label = lambda us: F.date_format(F.timestamp_micros(us + in_force(us)).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    buckets = bounds.select((F.col("number") - first).alias("bucket"), "start_us", label(F.col("start_us")).alias("label"), label(F.greatest(F.col("next_us") - MICROS, F.col("start_us"))).alias("end_label"), "n", "marked")
    return ZonedHistogram(buckets.orderBy("bucket"), width, last - first + 1, span["untimed"])
