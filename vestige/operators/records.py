"""Runs that replace runs, and what analysts attached to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.operators.lookups import sized
from vestige.relation import Relation


def latest_runs(sources: DataFrame) -> DataFrame:
    """``sources`` (source_id, relation, host, loaded_at, removed) with ``active``: the latest that isn't removed."""
    newest = sources.where("NOT removed").groupBy("relation", "host").agg(F.max(F.struct("loaded_at", "source_id")).alias("newest"))
    of_run = newest.select("relation", "host", F.col("newest.loaded_at").alias("loaded_at"), F.col("newest.source_id").alias("source_id"), F.lit(True).alias("is_newest"))
    out = sources.join(of_run, ["relation", "host", "loaded_at", "source_id"], "left").withColumn("active", F.coalesce(F.col("is_newest") & ~F.col("removed"), F.lit(False)))
    return out.select(*sources.columns, "active")


def supersede(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new run's rows, and the old run's rows of those (relation, host) that the new one doesn't have."""
    replaced = new.select(*keys).distinct()
    return old.join(sized(replaced), keys, "left_anti").unionByName(new)


def skip_covered(copies: DataFrame, aggregate: DataFrame) -> DataFrame:
    """Per-channel copies of the hosts that have no aggregate table."""
    return copies.join(sized(aggregate.select("host").distinct()), "host", "left_anti")


def rebind(marks: DataFrame, old: DataFrame, new: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Marks (row_id, mark) of old rows moved to the identical new rows (same hash, occurrence and host).

    ``outcome``: moved; left (no counterpart, or it has that mark already).
    """
    keys = ["row_hash", "occurrence", "host"]
    held = marks.join(old.select("row_id", *keys), "row_id")
    found = held.join(new.select(F.col("row_id").alias("new_id"), *keys), keys, "left")
    if taken is not None:
        there = taken.select(F.col("row_id").alias("new_id"), "mark", F.lit(True).alias("there"))
        found = found.join(there, ["new_id", "mark"], "left")
    else:
        found = found.withColumn("there", F.lit(None).cast("boolean"))
    moved = F.col("new_id").isNotNull() & F.col("there").isNull()
    return found.select("row_id", "mark", F.when(moved, F.col("new_id")).alias("new_id"), F.when(moved, "moved").otherwise("left").alias("outcome"))


def derived_marks(stored: DataFrame, evidence: DataFrame, entries: DataFrame) -> DataFrame:
    """(row_id, mark, by): malicious if a live entry of an analyst, or a reviewed one, holds the row; else agent_malicious; else as stored."""
    live = evidence.join(entries.where("NOT deleted"), "entry_id")
    vouched = F.col("by_analyst") | F.col("reviewed")
    by_row = live.groupBy("row_id").agg(F.bool_or(vouched).alias("vouched"), F.min(F.when(vouched, F.col("entry_id"))).alias("vouched_by"), F.min("entry_id").alias("agent_by"))
    derived = by_row.select("row_id", F.when(F.col("vouched"), "malicious").otherwise("agent_malicious").alias("mark"), F.coalesce("vouched_by", "agent_by").alias("by"))
    rest = stored.join(derived.select("row_id"), "row_id", "left_anti").select("row_id", "mark", F.lit(None).cast("long").alias("by"))
    return derived.select("row_id", "mark", F.col("by").cast("long").alias("by")).unionByName(rest)


def with_marks(relation: Relation, marks: DataFrame) -> Relation:
    """The relation with each row's mark in ``_mark`` (``marks``: row_id, mark; one mark a row), for filter documents."""
    named = marks.select(F.col("row_id").alias(relation.row_id), F.col("mark").alias("_mark"))
    return relation.with_df(relation.df.join(sized(named), relation.row_id, "left"))


def evidence_state(attached: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Attached rows (row_id, row_hash, source_id) against the rows now: unchanged, changed, superseded, source removed."""
    now = rows.select("row_id", F.col("row_hash").alias("hash_now"))
    state = F.when(F.col("active").isNull(), "source removed").when(~F.col("active"), "superseded").when(F.col("hash_now").eqNullSafe(F.col("row_hash")), "unchanged").otherwise("changed")
    return attached.join(sized(sources.select("source_id", "active")), "source_id", "left").join(now, "row_id", "left").select("row_id", state.alias("state"))


def record_seen(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_id): live linked entries, first and last time, hosts as a sorted list and their number.

    Repeated links and entries fall together before they meet, and one host of an entry carries its count, so nothing is counted
    distinct behind the join; a record's entries are added up by host, then its hosts are listed.
    """
    # Into a fixed number of parts, as merged ones would hold much more in memory; ordered rows fall together without a table of them.
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = entries.where("NOT deleted AND entry_id IS NOT NULL").select("entry_id", "host", "at").repartition(parts, "entry_id")
    live = live.groupBy("entry_id", "host").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    live = live.withColumn("entries", (F.row_number().over(W.partitionBy("entry_id").orderBy("host")) == 1).cast("long"))
    linked = links.where("entry_id IS NOT NULL").select("entry_id", "record_id").repartition(parts, "entry_id")
    linked = linked.withColumn("_before", F.row_number().over(W.partitionBy("entry_id", "record_id").orderBy("record_id"))).where("_before = 1").drop("_before")
    of_all = [F.sum("entries").alias("entries"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    by_host = linked.join(live, "entry_id").groupBy("record_id", "host").agg(*of_all)
    return by_host.groupBy("record_id").agg(*of_all, F.array_join(F.array_sort(F.collect_list("host")), ", ").alias("hosts"), F.count("host").alias("n_hosts"))


def mark_counts(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """Marked rows that are still active, by mark and relation, with totals (relation NULL)."""
    active = marks.join(rows.select("row_id", "relation"), "row_id")
    return active.rollup("mark", "relation").agg(F.count("*").alias("n")).where("mark IS NOT NULL")


def best_match(records: DataFrame, column: str, text: str) -> DataFrame:
    """Records that match a text, the best first: equal, starts with, contains."""
    name, low = F.lower(column), text.lower()
    rank = F.when(name == low, 0).when(F.startswith(name, F.lit(low)), 1).when(F.contains(name, F.lit(low)), 2)
    return records.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", column)
