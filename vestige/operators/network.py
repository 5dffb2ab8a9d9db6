"""Network use by program, user and time. Plain partial aggregations; a hot program is no hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.functions.times import in_hours, micros_of


def local_micros(at: Column, offset_minutes: int) -> Column:
    return micros_of(at) + offset_minutes * 60_000_000


def daily(usage: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """(host, exe, user, day): bytes, samples, profiles, and the interface of most samples (of several the greatest name)."""
    keys = ["host", "exe", "user"]
    day = F.floor(local_micros(F.col("at"), offset_minutes) / 86_400_000_000).cast("long").alias("day")
    rows = usage.where("at IS NOT NULL")
    # First by interface, so that the mode is a maximum over few rows.
    parts = rows.groupBy(*keys, day, "interface").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.count("*").alias("n"), F.collect_set("profile").alias("profiles"))
    return parts.groupBy(*keys, "day").agg(
        F.sum("sent").alias("sent"), F.sum("received").alias("received"), (F.sum("sent") + F.sum("received")).alias("total"), F.sum("n").alias("samples"),
        F.max(F.struct("n", "interface"))["interface"].alias("interface"), F.size(F.array_distinct(F.flatten(F.collect_list("profiles")))).cast("long").alias("profiles"),
    )


def hourly(usage: DataFrame, offset_minutes: int = 0, start: int = 8 * 60, end: int = 18 * 60) -> DataFrame:
    """(host, exe, user, hour): bytes, samples, share of the program's sent bytes, and whether the hour is out of office hours."""
    hour = F.floor(local_micros(F.col("at"), offset_minutes) / 3_600_000_000).cast("long").alias("hour")
    sums = usage.where("at IS NOT NULL").groupBy("host", "exe", "user", hour).agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.count("*").alias("samples"))
    # Totals of a program: an aggregate of the aggregate, joined back, rather than one window over all its hours.
    totals = sums.groupBy("host", "exe").agg(F.sum("sent").alias("all_sent"))
    share = F.when(F.col("all_sent") > 0, F.col("sent") / F.col("all_sent")).otherwise(0.0)
    minute = F.pmod(F.col("hour"), F.lit(24)) * 60
    return sums.join(totals, ["host", "exe"]).select("host", "exe", "user", "hour", "sent", "received", "samples", share.alias("share"), (~in_hours(minute, start, end)).alias("out_of_hours"))


def sessions(connections: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """(host, exe, user, day): sessions and connected seconds."""
    day = F.floor(local_micros(F.col("at"), offset_minutes) / 86_400_000_000).cast("long").alias("day")
    return connections.where("at IS NOT NULL").groupBy("host", "exe", "user", day).agg(F.count("*").alias("sessions"), F.sum("seconds").alias("seconds"))


def host_offset(values: DataFrame) -> DataFrame:
    """(host, minutes): minus the active bias, else minus the bias and the standard bias, of registry value rows."""
    pivot = values.groupBy("host").agg(*[F.max(F.when(F.col("name") == n, F.col("value").cast("long"))).alias(n) for n in ("ActiveTimeBias", "Bias", "StandardBias")])
    return pivot.select("host", (-F.coalesce(F.col("ActiveTimeBias"), F.col("Bias") + F.coalesce(F.col("StandardBias"), F.lit(0)))).alias("minutes"))


def top_programs(hours: DataFrame, n: int | None = None) -> DataFrame:
    """The programs of each host, by what they sent; with ``n`` the first of them."""
    sums = hours.groupBy("host", "exe").agg(F.sum("sent").alias("sent"))
    ranked = sums.withColumn("rank", F.row_number().over(W.partitionBy("host").orderBy(F.desc("sent"), "exe")))
    return ranked if n is None else ranked.where(F.col("rank") <= n)
