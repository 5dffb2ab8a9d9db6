"""Lookup joins: reference lists, maps of ids, visits and what they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes (as text) up to which a reference list is broadcast; a longer one is joined by shuffle.
MOST_BROADCAST = 200_000
MOST_BYTES = 64 << 20


def sized(df: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows and ``most_bytes`` bytes: counting stops behind so many rows."""
    size = F.octet_length(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    seen = df.limit(most + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= most and (seen["bytes"] or 0) <= most_bytes else df


def enrich(rows: DataFrame, lookup: DataFrame, keys: list[str], values: list[str], missing: str = "") -> DataFrame:
    """``rows`` with the lookup's values; the missing text where there is none.

    A key that the lookup holds several times gives the least of its value tuples, so no row is multiplied.
    """
    one = lookup.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_values")).select(*keys, *[F.col(f"_values.{v}").alias(v) for v in values])
    out = rows.join(sized(one), keys, "left")
    return out.withColumns({v: F.coalesce(F.col(v).cast("string"), F.lit(missing)) for v in values})


def associate(entries: DataFrame, programs: DataFrame, key: str, name: str) -> DataFrame:
    """Entries with their program's name, ``Unassociated`` without one; one join for both outputs."""
    return enrich(entries, programs, [key], [name], "Unassociated")


def first_of_each(df: DataFrame, key: Column, order: str, value: str) -> DataFrame:
    """(needle, value): of several reference rows for one needle the first in order; blanks are no needles."""
    needle = F.lower(F.trim(key))
    return df.select(needle.alias("needle"), F.col(order).alias("at"), F.col(value).alias("value")).where("needle <> ''").groupBy("needle").agg(F.min_by("value", "at").alias("value"))


def match_references(candidates: DataFrame, drivers: DataFrame, tools: DataFrame) -> DataFrame:
    """Candidates (hash, basename, ...) against two lists.

    ``drivers``: at, id, hashes and tags (arrays); a hash match is High, else a
    name match Medium. ``tools``: at, name, basenames (array); a name match is
    Medium, besides. Blanks never match; an unmatched hash falls back to the name.
    """
    by_hash = first_of_each(drivers.select("at", "id", F.explode("hashes").alias("k")), F.col("k"), "at", "id").select(F.col("needle").alias("h"), F.col("value").alias("hash_id"))
    by_name = first_of_each(drivers.select("at", "id", F.explode("tags").alias("k")), F.col("k"), "at", "id").select(F.col("needle").alias("b"), F.col("value").alias("name_id"))
    by_tool = first_of_each(tools.select("at", "name", F.explode("basenames").alias("k")), F.col("k"), "at", "name").select(F.col("needle").alias("b"), F.col("value").alias("tool"))
    keyed = candidates.withColumn("h", F.lower(F.trim("hash"))).withColumn("b", F.lower(F.trim("basename")))
    driven = keyed.join(sized(by_hash), "h", "left").join(sized(by_name), "b", "left").where("hash_id IS NOT NULL OR name_id IS NOT NULL")
    driven = driven.select(*candidates.columns, F.lit("driver").alias("list"), F.coalesce("hash_id", "name_id").alias("found"), F.when(F.col("hash_id").isNotNull(), "High").otherwise("Medium").alias("confidence"))
    tooled = keyed.join(sized(by_tool), "b").select(*candidates.columns, F.lit("tool").alias("list"), F.col("tool").alias("found"), F.lit("Medium").alias("confidence"))
    return driven.unionByName(tooled)


def outward(visits: DataFrame, targets: DataFrame, key: str, target_key: str, only: str) -> DataFrame:
    """Visits with their targets (a dangling key is kept, and noted), and targets without visits as rows of their own."""
    marked = targets.withColumn("_there", F.lit(True))
    joined = visits.join(marked, visits[key] == marked[target_key], "left").withColumn("note", F.when(F.col("_there").isNull(), "dangling").otherwise("")).drop("_there")
    alone = targets.join(visits.select(F.col(key).alias(target_key)).distinct(), target_key, "left_anti").withColumn("note", F.lit(only))
    return joined.unionByName(alone, allowMissingColumns=True)


def joined_chain(rows: DataFrame, key: str, order: str, value: str, separator: str = " -> ") -> DataFrame:
    """(key, chain): values in order, joined as text."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), separator).alias("chain"))

