"""One value, or a set of values, looked for in every cell; rows around a time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.operators.storage import checkpointed
from vestige.relation import Relation


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cells(relation: Relation, keep: Column | None = None) -> DataFrame:
    """(relation, column, host, seen_at, value): the non-empty data cells of the rows that ``keep`` holds for."""
    df = relation.df if keep is None else relation.df.where(keep)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), relation.text_of(c).alias("value")) for c in relation.data])
    host = F.col(relation.host).cast("string") if relation.host else F.lit(None).cast("string")
    at = F.col(relation.time) if relation.time else F.lit(None).cast("timestamp")
    rows = df.select(host.alias("host"), at.alias("seen_at"), F.explode(pairs).alias("x"))
    return rows.select(F.lit(relation.name).alias("relation"), "x.column", "host", "seen_at", "x.value").where("value <> ''")


def find_everywhere(relations: list[Relation], value: str, exact: bool = False) -> DataFrame:
    """(relation, column, host): rows whose cell is or contains the value, ignoring case; first and last time.

    Rows without any such cell are dropped before the cells are taken apart.
    """
    low = value.lower()
    test = (lambda c: F.lower(c) == low) if exact else (lambda c: F.contains(F.lower(c), F.lit(low)))
    parts = []
    for r in relations:
        may = reduce(lambda a, b: a | b, (F.coalesce(test(r.text_of(c)), F.lit(False)) for c in r.data))
        parts.append(cells(r, may).where(test(F.col("value"))))
    return union(parts).groupBy("relation", "column", "host").agg(F.count("*").alias("n"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def hosts_not_seen(relations: list[Relation], hits: DataFrame) -> DataFrame:
    hosts = union([r.df.select(F.col(r.host).cast("string").alias("host")).distinct() for r in relations if r.host]).distinct()
    return hosts.join(hits.select("host").distinct(), "host", "left_anti")


def sightings(relations: list[Relation], indicators: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """For each indicator (column ``value``), ignoring ASCII case: hits, hosts, first and last time. All at once, one unpivot."""
    wanted = indicators.select(ascii_fold(F.col("value")).alias("needle"), "value").distinct()
    if wanted.limit(most_broadcast + 1).count() <= most_broadcast:
        wanted = F.broadcast(wanted)
    found = union([cells(r) for r in relations]).select(ascii_fold(F.col("value")).alias("needle"), "relation", "host", "seen_at")
    return found.join(wanted, "needle").groupBy("value").agg(F.count("*").alias("hits"), F.countDistinct("host").alias("hosts"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def around(relations: list[Relation], host: str, low: Column, high: Column) -> DataFrame:
    """Rows of one host between two times, counted for each relation, zeros too."""
    parts = []
    for r in relations:
        inside = (F.col(r.host).cast("string") == host) & F.col(r.time).between(low, high)
        parts.append(r.df.agg(F.count_if(inside).alias("n")).select(F.lit(r.name).alias("relation"), "n"))
    return union(parts)


def around_anchors(relation: Relation, anchors: DataFrame, seconds: int) -> DataFrame:
    """(anchor, row) pairs of one host within ``seconds``: an equi-join on host and time bucket, then the exact test.

    ``anchors``: anchor_id, host, at. Each anchor goes to the three buckets it can reach.
    """
    width = seconds or 1
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width)
    reach = anchors.select("anchor_id", F.col("host").cast("string").alias("anchor_host"), "at", F.explode(F.array(*[bucket(F.col("at")) + k for k in (-1, 0, 1)])).alias("bucket"))
    rows = relation.df.withColumn("anchor_host", F.col(relation.host).cast("string")).withColumn("bucket", bucket(F.col(relation.time)))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    near = F.abs(micros(F.col(relation.time)) - micros(F.col("at"))) <= seconds * 1_000_000
    return rows.join(reach, ["anchor_host", "bucket"]).where(near)


def summary_line(columns: list[str], most: int = 300) -> Column:
    """The first four non-empty cells, joined by a dot."""
    shown = F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.substring(F.array_join(F.slice(shown, 1, 4), " · "), 1, most)


def merged_rows(relations: list[Relation], keep: dict[str, Column], limit: int) -> DataFrame:
    """The first rows over all relations by time (none last), relation and id, numbered from 0 in ``position``.

    The ids are ranked once, and kept; summaries are made for these rows alone.
    """
    narrow = union([r.df.where(keep[r.name]).select(F.lit(r.name).alias("relation"), F.col(r.row_id).cast("string").alias("row_id"), F.col(r.time).alias("seen_at")) for r in relations])
    keys = [F.col("seen_at").asc_nulls_last(), F.col("relation").asc(), F.col("row_id").asc()]
    top = checkpointed(narrow.orderBy(*keys).limit(limit).withColumn("position", F.row_number().over(W.orderBy(*keys)).cast("long") - 1))  # at most ``limit`` rows
    parts = []
    for r in relations:
        wide = r.df.select(F.col(r.row_id).cast("string").alias("row_id"), summary_line(list(r.data)).alias("summary"))
        parts.append(wide.join(F.broadcast(top.where(F.col("relation") == r.name)), "row_id"))
    return union(parts).orderBy("position")


# Scopes ----------------------------------------------------------------------


@dataclass(frozen=True)
class Scope:
    """Hosts (all if none are named) and times from ``start`` to ``end``, both included; open where null."""

    hosts: tuple[str, ...] = ()
    start: datetime | None = None
    end: datetime | None = None

    def of(self, relation: Relation) -> Relation | None:
        """The relation's rows in scope; none if it has no host, or no time, to be asked for. Plain comparisons, so that scans can use them."""
        if self.hosts and not relation.host or (self.start or self.end) and not relation.time:
            return None
        df = relation.df
        if self.hosts:
            df = df.where(F.col(relation.host).isin(list(self.hosts)))
        if self.start:
            df = df.where(F.col(relation.time) >= F.lit(self.start))
        if self.end:
            df = df.where(F.col(relation.time) <= F.lit(self.end))
        return relation.with_df(df)


@dataclass(frozen=True)
class Found:
    """``hits``: relation, column, host, n, first_seen, last_seen; ``relations``: relation, searched, n, for every relation asked; ``hosts_not_seen``: host."""

    hits: DataFrame
    relations: DataFrame
    hosts_not_seen: DataFrame


#: Fixed value: characters of a value that is looked for.
MAX_VALUE = 1000


def find_in_scope(relations: list[Relation], value: str, scope: Scope, exact: bool = False) -> Found:
    """``find_everywhere`` over the rows in scope, with the relations that were left out or had no hit, and the hosts that were looked at and had none."""
    if not value or len(value) > MAX_VALUE:
        raise ValueError(f"a value of 1 to {MAX_VALUE} characters")
    spark = relations[0].df.sparkSession
    inside = [(r.name, scope.of(r)) for r in relations]
    searched = [r for _, r in inside if r is not None]
    if searched:
        hits = checkpointed(find_everywhere(searched, value, exact))  # counted, and read three times
    else:
        hits = spark.createDataFrame([], "relation string, column string, host string, n long, first_seen timestamp, last_seen timestamp")
    names = spark.createDataFrame([(name, r is not None) for name, r in inside], "relation string, searched boolean")
    counted = names.join(hits.groupBy("relation").agg(F.sum("n").alias("n")), "relation", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    with_host = [r for r in searched if r.host]
    unseen = hosts_not_seen(with_host, hits) if with_host else spark.createDataFrame([], "host string")
    return Found(hits, counted, unseen)


def sightings_by_relation(relations: list[Relation], indicators: DataFrame, scope: Scope = Scope(), most_broadcast: int = 100_000) -> DataFrame:
    """For each indicator and relation, and for each indicator (relation null): hits, hosts, first and last time, in scope. One unpivot; indicators not seen have one row with no hits."""
    wanted = indicators.select(ascii_fold(F.col("value")).alias("needle"), "value").distinct()
    inside = [r for r in (scope.of(r) for r in relations) if r is not None]
    few = wanted.limit(most_broadcast + 1).count() <= most_broadcast
    out = {"hits": F.count("*"), "hosts": F.countDistinct("host"), "first_seen": F.min("seen_at"), "last_seen": F.max("seen_at")}
    aggregates = [c.alias(n) for n, c in out.items()]
    if not inside:
        return wanted.select("value", F.lit(None).cast("string").alias("relation"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("hosts"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"))
    found = union([cells(r) for r in inside]).select(ascii_fold(F.col("value")).alias("needle"), "relation", "host", "seen_at")
    met = found.join(F.broadcast(wanted) if few else wanted, "needle")
    counted = met.groupingSets([["value", "relation"], ["value"]], "value", "relation").agg(*aggregates)
    totals = wanted.select("value").join(counted.where("relation IS NULL"), "value", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("hits", "hosts")})
    return counted.where("relation IS NOT NULL").unionByName(totals)
