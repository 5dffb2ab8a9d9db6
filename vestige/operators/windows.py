"""Order, gaps, pages and positions, without a window over all rows."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.functions.times import hour_boundaries, micros_of
from vestige.operators.aggregates import width_for
from vestige.operators.lookups import sized
from vestige.operators.storage import checkpointed
from vestige.relation import Relation


def ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def event_filter(channel: str, code: str, time: str, contains: str, include: list[int], exclude: list[int], start: str, end: str) -> Column:
    out = F.contains(F.lower(channel), F.lit(contains.lower())) & F.col(time).between(ntz(start), ntz(end))
    if include:
        out = out & F.col(code).isin(include)
    return out & ~F.col(code).isin(exclude) if exclude else out


def local_to_utc(text: str, zone: str) -> str:
    """A wall-clock time as UTC text; times that a clock change skips or repeats are refused."""
    from datetime import datetime, timedelta, timezone

    wall = datetime.fromisoformat(text)
    found = {(wall.replace(tzinfo=ZoneInfo(zone), fold=f)).astimezone(timezone.utc) for f in (0, 1)}
    found = {t for t in found if t.astimezone(ZoneInfo(zone)).replace(tzinfo=None, fold=0) == wall}
    if len(found) != 1:
        raise ValueError(f"{text} is {'skipped' if not found else 'ambiguous'} in {zone}")
    return (found.pop() + timedelta()).strftime("%Y-%m-%d %H:%M:%S")


def wall_clock_range(time: str, start: str, end: str, zone: str) -> Column:
    """Between two wall-clock seconds, the whole last second included; constant bounds, so the scan can use them."""
    return (F.col(time) >= ntz(local_to_utc(start, zone))) & (F.col(time) < ntz(local_to_utc(end, zone)) + F.expr("INTERVAL 1 SECOND"))


def lagged(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the value of the row before in its group, null for the first; no group lies in one task.

    Rows are range-partitioned by group and order and kept in the shared folder;
    the row before is looked up inside a partition, and for a partition's first row
    of a group among the last rows of the partitions before (one row for each
    partition and group).
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(partitions, *by, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", *by).orderBy(*order)
    last = placed.groupBy("_part", *by).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    edges = last.withColumn("_edge", F.lag("_last").over(W.partitionBy(*by).orderBy("_part"))).drop("_last")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("_part", *by)]
    rows = placed.withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(inside)).alias("r").join(sized(edges).alias("e"), same, "left")
    return rows.select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce("r._before", "e._edge")["v"].alias(name))


def record_gaps(df: DataFrame, source: str, number: str) -> DataFrame:
    """Missing record numbers of each source; repeated numbers and null numbers are no gap."""
    rows = lagged(df.select(source, number).where(F.col(number).isNotNull()), [source], [number], number, "before")
    gaps = rows.where(F.col(number) - F.col("before") > 1)
    return gaps.select(source, (F.col("before") + 1).alias("first_missing"), (F.col(number) - 1).alias("last_missing"), (F.col(number) - F.col("before") - 1).alias("n"))


def blackout_gaps(relation: Relation, by: list[str], hours: int = 6) -> DataFrame:
    """(by..., before, after, hours): silences of at least so many hour boundaries within a group; rows without time don't count."""
    rows = lagged(relation.df.where(F.col(relation.time).isNotNull()).select(*by, F.col(relation.time).alias("after")), by, ["after"], "after", "before")
    return rows.withColumn("hours", hour_boundaries(F.col("before"), F.col("after"))).where(F.col("hours") >= hours).select(*by, "before", "after", "hours")


def repeats(df: DataFrame, content: list[str], order: str, name: str = "duplicate") -> DataFrame:
    """``df`` with whether a row repeats an earlier one's content: the least ``order`` (unique) of each content, found by partial aggregation."""
    first = df.groupBy(*[F.col(c).alias(f"_{c}") for c in content]).agg(F.min(order).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content]
    return df.join(first, same).select(*df.columns, (F.col(order) != F.col("_first")).alias(name))


def histogram(relation: Relation, most: int, marked: Column) -> DataFrame:
    """As ``aggregates.histogram``, for times without zone."""
    timed = relation.df.where(F.col(relation.time).isNotNull()).select(F.floor(micros_of(F.col(relation.time)) / 1_000_000).cast("long").alias("sec"), marked.alias("marked"))
    ends = timed.agg(F.min("sec").alias("a"), F.max("sec").alias("b")).first()
    width = width_for(ends["a"] * 1_000_000, ends["b"] * 1_000_000, most) if ends["a"] is not None else 1
    first = (ends["a"] or 0) // width
    bucket = F.floor(F.col("sec") / width).cast("long")
    return timed.groupBy((bucket - first).alias("bucket"), (bucket * width).alias("start_second")).agg(F.count("*").alias("n"), F.count_if("marked").alias("marked"))


#: Code points of a cell that a page shows.
CELL = 2000


def sort_keys(relation: Relation, order: list[str]) -> list[Column]:
    """Total order: each column (``-`` before it: descending) by its typed value, or by its text in lower case; nulls last; then the row id."""
    keys = []
    for c in order:
        name = c.lstrip("-")
        value = F.col(name) if name in relation.typed else F.lower(relation.text_of(name))
        keys.append(value.desc_nulls_last() if c.startswith("-") else value.asc_nulls_last())
    return [*keys, F.col(relation.row_id).asc()]


def page(relation: Relation, condition: Column, order: list[str], limit: int, offset: int) -> DataFrame:
    """One page in total order: ids are ranked first, then only their rows are read wide.

    ``position`` from 0 over all picked rows; text cells are cut at ``CELL`` code
    points; ``failed`` names the typed cells that have text but no value;
    ``has_more``: whether rows come after the page. A page beyond the end is empty.
    """
    keys = sort_keys(relation, order)
    ids = relation.df.where(condition).orderBy(*keys).offset(offset).limit(limit + 1).select(relation.row_id)
    rows = relation.df.join(F.broadcast(ids), relation.row_id)  # at most ``limit`` + 1 ids
    numbered_rows = rows.withColumn("position", F.row_number().over(W.orderBy(*keys)).cast("long") - 1 + offset).withColumn("has_more", F.count("*").over(W.partitionBy()) > limit)
    failed = [F.when(F.col(c).isNull() & (F.coalesce(relation.text_of(c), F.lit("")) != ""), F.lit(c)) for c in sorted(relation.typed)]
    shown = numbered_rows.where(F.col("position") < offset + limit).withColumn("failed", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))
    return shown.withColumns({c: F.substring(relation.text_of(c), 1, CELL) for c in relation.data if c not in relation.typed}).orderBy("position")


def row_offset(relation: Relation, order: str, row_id: int) -> DataFrame:
    """How many rows sort before one row, nulls last as on a page: a count, not a sort."""
    own = relation.df.where(F.col(relation.row_id) == row_id).select(F.col(order).alias("own"), F.col(relation.row_id).alias("own_id"))
    value, id_of = F.col(order), F.col(relation.row_id)
    earlier = F.coalesce(value < F.col("own"), value.isNotNull() & F.col("own").isNull())
    before = earlier | (value.eqNullSafe(F.col("own")) & (id_of < F.col("own_id")))
    return relation.df.select(order, relation.row_id).join(F.broadcast(own), F.lit(True)).agg(F.count_if(before).alias("place"))


def numbered(df: DataFrame, order: list[str], hit: Column) -> DataFrame:
    """Every row's position in total order, and of hits their running number (``ordinal``, null for other rows).

    Rows are range-partitioned and sorted once, and that copy is kept in the shared
    folder, so its partitions stay what they are. Each counts its own rows; the
    counts of the partitions before (one row each) are added.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = (1 << 33) - 1  # the lower part of an increasing id counts the rows of a partition
    placed = df.withColumn("hit", hit).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("nth", F.monotonically_increasing_id()))
    part = F.shiftright("nth", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("hits").over(earlier), F.lit(0)).alias("hit_base"))
    hits = placed.where("hit").withColumn("nth_hit", F.monotonically_increasing_id().bitwiseAND(F.lit(low)))
    rest = placed.where("hit IS NULL OR NOT hit").withColumn("nth_hit", F.lit(None).cast("long"))
    rows = hits.unionByName(rest).withColumn("part", part).join(F.broadcast(bases), "part")
    return rows.withColumn("position", F.col("nth").bitwiseAND(F.lit(low)) + F.col("base") + 1).withColumn("ordinal", F.col("nth_hit") + F.col("hit_base") + 1).drop("part", "nth", "nth_hit", "base", "hit_base")


def occurrences(df: DataFrame, content: list[str], order: str) -> DataFrame:
    """The n-th occurrence of each row's content: the window sees only contents that repeat."""
    key = F.xxhash64(*content)
    hashed = df.withColumn("content_hash", key)
    repeated = hashed.groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1").select("content_hash")
    again = hashed.join(repeated, "content_hash", "left_semi").withColumn("occurrence", F.row_number().over(W.partitionBy(*content).orderBy(order)))
    once = hashed.join(repeated, "content_hash", "left_anti").withColumn("occurrence", F.lit(1))
    return again.unionByName(once).drop("content_hash")
