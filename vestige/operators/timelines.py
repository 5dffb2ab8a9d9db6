"""Times from many tables and columns in one list."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.functions.times import day_boundaries
from vestige.operators.search import union


@dataclass(frozen=True)
class Leg:
    """A table of a timeline: its rows' id, their time (null: they have none), and the column that a name is looked for in."""

    label: str
    df: DataFrame
    row_id: str
    time: str | None = None
    name: str | None = None

    def rows(self) -> DataFrame:
        at = F.col(self.time) if self.time else F.lit(None)
        return self.df.select(F.lit(self.label).alias("leg"), F.col(self.row_id).alias("id"), at.cast("timestamp_ntz").alias("at"))


def cross_timeline(legs: list[Leg], low: Column, high: Column) -> DataFrame:
    """(leg, id, at) of all rows of all legs between two times, both included, in time order. The bounds reach each leg's scan."""
    within = [Leg(x.label, x.df.where(F.col(x.time).between(low, high)), x.row_id, x.time) for x in legs]
    return union([x.rows() for x in within]).orderBy("at", "leg", "id")


def everywhere(legs: list[Leg], name: str) -> DataFrame:
    """(leg, id, at) of the rows whose name is ``name``, in whatever case; rows without time come last."""
    hits = [Leg(x.label, x.df.where(F.lower(F.col(x.name).cast("string")) == name.lower()), x.row_id, x.time) for x in legs]
    return union([x.rows() for x in hits]).orderBy(F.col("at").asc_nulls_last(), "leg", "id")


def times_of(df: DataFrame, row_id: str, times: dict[str, str]) -> DataFrame:
    """(id, type, at): a row for each time that isn't null. ``times``: type and column."""
    cells = F.array(*[F.struct(F.lit(kind).alias("type"), F.col(c).cast("timestamp_ntz").alias("at")) for kind, c in times.items()])
    return df.select(F.col(row_id).alias("id"), F.explode(F.filter(cells, lambda x: x["at"].isNotNull())).alias("x")).select("id", "x.type", "x.at")


def run_times(df: DataFrame, keys: list[str], executable: str, files: str, times: str) -> DataFrame:
    """A row for each run time, with the first loaded file whose path ends with the executable's name, or that name where none does."""
    path = F.get(F.filter(files, lambda f: F.endswith(f, F.col(executable))), F.lit(0))
    return df.select(*keys, F.coalesce(path, F.col(executable)).alias("path"), F.explode(times).alias("run_time"))


def with_reason(df: DataFrame, reasons: str, reason: str, time: str, low: Column, high: Column) -> DataFrame:
    """Journal rows between two times, both included, one of whose reasons (a text joined by ``|``) is ``reason``."""
    return df.where(F.col(time).between(low, high) & F.array_contains(F.split(reasons, r"\|"), reason))


def numbered_days(df: DataFrame, keys: list[str], year: str) -> DataFrame:
    """(keys..., nth, day, accesses): a row for each column ``Day1`` to ``Day366`` that isn't null; ``day`` is that day of the year in ``year``."""
    days = [c for c in df.columns if re.fullmatch(r"Day\d{1,3}", c)]
    long = df.unpivot([*keys, year], days, "_name", "accesses").where("accesses IS NOT NULL")
    nth = F.substr("_name", F.lit(4)).cast("int")
    return long.select(*keys, nth.cast("long").alias("nth"), F.date_add(F.make_date(F.col(year), F.lit(1), F.lit(1)), nth - 1).alias("day"), "accesses")


def coverage(df: DataFrame, by: dict[str, Column], time: str) -> DataFrame:
    """For each combination of ``by``: rows, first and last time, and the day boundaries between them."""
    found = df.groupBy(*[c.alias(name) for name, c in by.items()]).agg(F.count("*").alias("n"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    return found.withColumn("days", day_boundaries(F.col("first_seen"), F.col("last_seen")))
