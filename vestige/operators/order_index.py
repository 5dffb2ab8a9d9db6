"""An order index: the sorted copy of a relation, kept, so that any page of it is read from the partitions that hold it.

Rows are range-partitioned by the total order, sorted, and written to the
shared folder, a folder for each partition. How many rows and matches each
partition has (a few numbers a partition) is kept on the driver; a page, a row's place
and a step to the next or previous match then touch one or two partitions, however
deep they lie.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.operators.storage import fresh_path
from vestige.operators.windows import CELL, sort_keys
from vestige.relation import Relation

# Fixed value: rows of one page, and matches of one step.
MAX_LIMIT = 1000
#: Names of the index beside the relation's own.
PART, NTH, HIT = "_part", "_nth", "_hit"


@dataclass(frozen=True)
class OrderIndex:
    """``rows`` before each partition and after the last, and ``hits`` likewise, by partition number."""

    relation: Relation
    copy: DataFrame
    parts: list[int]
    rows: list[int]
    hits: list[int]

    def _between(self, first: int, end: int) -> DataFrame:
        """The rows with positions from ``first`` to before ``end``, with ``position``: only their partitions are read."""
        low, high = max(bisect_right(self.rows, first) - 1, 0), bisect_left(self.rows, end)
        wanted = list(range(low, min(high, len(self.parts))))
        base = F.coalesce(*[F.when(F.col(PART) == self.parts[k], F.lit(self.rows[k])) for k in wanted]) if wanted else F.lit(0)
        inside = F.col(PART).isin([self.parts[k] for k in wanted]) if wanted else F.lit(False)
        return self.copy.where(inside).withColumn("position", (base + F.col(NTH)).cast("long")).where(F.col("position").between(first, end - 1))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows from ``offset``, with ``position``, ``failed`` (typed cells with text but no value) and ``has_more``; text cells are cut at ``CELL``."""
        check(limit, offset)
        r = self.relation
        failed = [F.when(F.col(c).isNull() & (F.coalesce(r.text_of(c), F.lit("")) != ""), F.lit(c)) for c in sorted(r.typed) if c in self.copy.columns]
        shown = self._between(offset, offset + limit).withColumn("failed", F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))
        cut = {c: F.substring(r.text_of(c), 1, CELL) for c in r.data if c in self.copy.columns and c not in r.typed}
        return shown.withColumns({**cut, "has_more": F.lit(self.rows[-1] > offset + limit)}).drop(PART, NTH, HIT).orderBy("position")

    def place(self, row_id: object) -> DataFrame:
        """(place): how many rows sort before the row; no row if the index doesn't hold it. Reads the ids alone."""
        base = F.coalesce(*[F.when(F.col(PART) == p, F.lit(n)) for p, n in zip(self.parts, self.rows)], F.lit(0))
        return self.copy.where(F.col(self.relation.row_id) == F.lit(row_id)).select((base + F.col(NTH)).cast("long").alias("place"))

    def matches(self, limit: int, start: int | None = None, backward: bool = False) -> DataFrame:
        """(position, row_id, ordinal) of up to ``limit`` matches after ``start``, nearest first, or before it.

        ``ordinal`` counts all matches from 1. Only partitions from that of ``start`` to the one in which ``limit`` matches are reached are read.
        """
        check(limit, start or 0)
        count = len(self.parts)
        if backward:
            end = min(start, self.rows[-1]) if start is not None else self.rows[-1]
            at = max(bisect_left(self.rows, end) - 1, 0)
            # All matches of the first partition may lie behind ``start``, so its own aren't counted on.
            low = max(bisect_right(self.hits, self.hits[at] - limit) - 1, 0) if self.hits[at] > limit else 0
            wanted = range(low, min(at + 1, count))
        else:
            begin = -1 if start is None else start
            at = max(bisect_right(self.rows, begin + 1) - 1, 0)
            enough = self.hits[min(at + 1, count)] + limit
            high = bisect_left(self.hits, enough)
            wanted = range(at, min(max(high, at + 1), count))
        if not len(wanted):
            return self.copy.limit(0).select(F.lit(0).cast("long").alias("position"), F.col(self.relation.row_id).alias("row_id"), F.lit(0).cast("long").alias("ordinal"))
        numbers = lambda known: F.coalesce(*[F.when(F.col(PART) == self.parts[k], F.lit(known[k])) for k in wanted])
        hits = self.copy.where(F.col(PART).isin([self.parts[k] for k in wanted]) & F.col(HIT)).select(PART, NTH, F.col(self.relation.row_id).alias("row_id"))
        # Ranks inside a partition that is read; with the matches of those before they are ranks over all.
        ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy(PART).orderBy(NTH)))
        placed = ranked.select((numbers(self.rows) + F.col(NTH)).cast("long").alias("position"), "row_id", (numbers(self.hits) + F.col("rank")).cast("long").alias("ordinal"))
        if backward:
            return (placed.where(F.col("position") < start) if start is not None else placed).orderBy(F.desc("position")).limit(limit)
        return placed.where(F.col("position") > begin).orderBy("position").limit(limit)

    def count(self) -> int:
        return self.rows[-1]

    def match_count(self) -> int:
        return self.hits[-1]


def check(limit: int, offset: int) -> None:
    if not 0 < limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"a page has 1 to {MAX_LIMIT} rows, from 0 on")


def build(relation: Relation, order: list[str], condition: Column | None = None, hit: Column | None = None, carry: list[str] | None = None, partitions: int | None = None) -> OrderIndex:
    """The index of the rows for which ``condition`` holds, in the order of ``windows.sort_keys``; ``hit`` marks matches.

    ``carry``: columns that pages show beside the id (all by default).
    """
    df = relation.df if condition is None else relation.df.where(condition)
    spark = df.sparkSession
    marked = df.withColumn(HIT, F.coalesce(hit, F.lit(False)) if hit is not None else F.lit(False))
    keys = sort_keys(relation, order)
    placed = marked.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    low = (1 << 33) - 1  # the lower part of an increasing id counts the rows of a partition
    numbered = placed.withColumn("_id", F.monotonically_increasing_id())
    kept = list(dict.fromkeys([relation.row_id, *(carry if carry is not None else df.columns)]))
    path = fresh_path(spark, "order-index")
    numbered.select(*[F.col(f"`{c}`") for c in kept], HIT, F.col("_id").bitwiseAND(F.lit(low)).alias(NTH), F.shiftright("_id", 33).alias(PART)).write.partitionBy(PART).parquet(path)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*[F.col(f"`{c}`") for c in kept], HIT).schema.fields] + [f"{NTH} bigint", f"{PART} bigint"])
    copy = spark.read.schema(schema).parquet(path)
    sizes = sorted((r[PART], r["rows"], r["hits"]) for r in copy.groupBy(PART).agg(F.count("*").alias("rows"), F.count_if(HIT).alias("hits")).collect())  # a row for each partition
    sums = lambda i: [0, *accumulate(s[i] for s in sizes)]
    return OrderIndex(relation, copy, [s[0] for s in sizes], sums(1), sums(2))
