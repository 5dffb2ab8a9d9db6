"""Grouping, stacking, values, histograms and counts over a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.operators.predicates import MARK_COLUMN
from vestige.relation import Relation, blank_to_null

#: The widths a histogram may have, in seconds.
WIDTHS = [1, 10, 60, 300, 900, 3600, 21600, 86400, 604800, 2592000]


def _keys(relation: Relation, by: list[str]) -> list[Column]:
    return [blank_to_null(relation.text_of(c)).alias(c) for c in by]


# Columns of one grouping, groups of one page, code points of a key that is shown.
MAX_BY, MAX_LIMIT, MAX_KEY = 4, 1000, 2000


def _group_key(relation: Relation, column: str) -> Column:
    """A cell's text, empty as null; of ``_mark`` the mark, null for none."""
    if column == MARK_COLUMN:
        return F.nullif(F.nullif(F.col(MARK_COLUMN), F.lit("")), F.lit("none"))
    return blank_to_null(relation.text_of(column))


def groups(relation: Relation, by: list[str], parent: dict[str, str | None] | None = None, marked: Column | None = None) -> DataFrame:
    """The next level of a grouping: key, rows, first and last time, and each as the row wrote it, marked rows; commonest first.

    Of several rows with the earliest (or latest) time the least text is shown (the greatest).
    """
    parent = parent or {}
    if not 0 < len(by) <= MAX_BY or len(parent) >= len(by):
        raise ValueError(f"1 to {MAX_BY} columns, and a shorter parent")
    df = relation.df
    for column, value in parent.items():
        df = df.where(_group_key(relation, column).eqNullSafe(F.lit(value or None)))
    out = {"n": F.count("*")}
    if relation.time:
        timed = F.when(F.col(relation.time).isNotNull(), F.struct(F.col(relation.time).alias("at"), relation.text_of(relation.time).alias("text")))
        out |= {"first_seen": F.min(relation.time), "last_seen": F.max(relation.time), "first_text": F.min(timed)["text"], "last_text": F.max(timed)["text"]}
    else:
        none = F.lit(None)
        out |= {"first_seen": F.max(none.cast("timestamp")), "last_seen": F.max(none.cast("timestamp")), "first_text": F.max(none.cast("string")), "last_text": F.max(none.cast("string"))}
    out["marked"] = F.count_if(marked if marked is not None else F.lit(False))
    counted = df.groupBy(_group_key(relation, by[len(parent)]).alias("key")).agg(*[c.alias(n) for n, c in out.items()])
    return counted.orderBy(F.desc("n"), F.col("key").asc_nulls_last())


def group_page(relation: Relation, by: list[str], parent: dict[str, str | None] | None = None, marked: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """``limit`` of the groups from ``offset``, with their ``position``, ``truncated`` (groups come after the page), and the key cut at ``MAX_KEY`` (``key_clipped``) beside ``full_key``."""
    if not 0 < limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"1 to {MAX_LIMIT} groups, from 0 on")
    order = [F.desc("n"), F.col("key").asc_nulls_last()]
    some = groups(relation, by, parent, marked).offset(offset).limit(limit + 1)  # at most ``limit`` + 1 rows
    placed = some.withColumns({"position": F.row_number().over(W.orderBy(*order)).cast("long") - 1 + offset, "truncated": F.count("*").over(W.partitionBy()) > limit})
    shown = placed.where(F.col("position") < offset + limit).withColumn("full_key", F.col("key"))
    return shown.withColumns({"key": F.substring("full_key", 1, MAX_KEY), "key_clipped": F.coalesce(F.char_length("full_key") > MAX_KEY, F.lit(False))}).orderBy("position")


def stack(relation: Relation, by: list[str], marked: Column | None = None) -> DataFrame:
    """Each combination of values: rows, distinct hosts, first and last time, marked rows."""
    return relation.df.groupBy(*_keys(relation, by)).agg(
        F.count("*").alias("n"),
        F.countDistinct(blank_to_null(F.col(relation.host))).alias("hosts"),
        F.min(relation.time).alias("first_seen"),
        F.max(relation.time).alias("last_seen"),
        F.count_if(marked if marked is not None else F.lit(False)).alias("marked"),
    )


def rarest(stacked: DataFrame, by: list[str]) -> DataFrame:
    return stacked.orderBy("n", *[F.col(c).asc_nulls_last() for c in by])


def commonest(stacked: DataFrame, by: list[str]) -> DataFrame:
    return stacked.orderBy(F.desc("n"), *[F.col(c).asc_nulls_last() for c in by])


def stack_totals(relation: Relation, by: list[str]) -> DataFrame:
    """Rows, distinct combinations (an empty cell is a value) and distinct hosts."""
    combination = F.struct(*[F.coalesce(k, F.lit("")) for k in (blank_to_null(relation.text_of(c)) for c in by)])
    return relation.df.agg(F.count("*").alias("n"), F.countDistinct(combination).alias("combinations"), F.countDistinct(blank_to_null(F.col(relation.host))).alias("hosts"))


def values(relation: Relation, column: str, contains: str | None = None) -> DataFrame:
    """One column's values and counts, the empty one as NULL."""
    text = blank_to_null(relation.text_of(column))
    counted = relation.df.groupBy(text.alias("value")).agg(F.count("*").alias("n"))
    return counted.where(F.contains(F.lower("value"), F.lit(contains.lower()))) if contains else counted


def width_for(first_micros: int, last_micros: int, most: int) -> int:
    """The smallest width in seconds that needs at most ``most`` buckets."""
    for width in WIDTHS:
        if last_micros // 1_000_000 // width - first_micros // 1_000_000 // width + 1 <= most:
            return width
    return WIDTHS[-1]


def count_view(relation: Relation, condition: Column) -> DataFrame:
    """Rows that the condition picks, all rows, and typed cells among the picked that failed to convert."""
    failed = sum((F.count_if(condition & F.col(c).isNull() & (F.coalesce(relation.text_of(c), F.lit("")) != "")) for c in sorted(relation.typed)), F.lit(0))
    return relation.df.agg(F.count_if(condition).alias("selected"), F.count("*").alias("total"), failed.cast("long").alias("failed_cells"))


def empty_columns(relation: Relation) -> DataFrame:
    """The data columns without any non-empty cell: one pass, then one row a column."""
    counted = relation.df.agg(*[F.count(blank_to_null(relation.text_of(c))).alias(c) for c in relation.data])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in relation.data])
    return counted.select(F.explode(pairs).alias("x")).where("x.n = 0").select("x.column")


def cast_health(relation: Relation, column: str) -> DataFrame:
    """Rows, blank cells, cells that converted and cells that failed."""
    text = F.coalesce(relation.text_of(column), F.lit(""))
    typed = F.col(column)
    return relation.df.agg(F.count("*").alias("n"), F.count_if(text == "").alias("blank"), F.count(typed).alias("converted"), F.count_if(typed.isNull() & (text != "")).alias("failed"))


def counted_list(df: DataFrame, by: list[str], item: str, name: str) -> DataFrame:
    """For each group, its items as ``item (n)``, commonest first, joined by `` | ``; two partial aggregations."""
    counts = df.groupBy(*by, item).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(item).alias("item"))))
    text = F.transform(ordered, lambda x: F.concat(x["item"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")")))
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.array_join(text, " | ").alias(name))
