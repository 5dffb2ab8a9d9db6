"""Pages at any depth, steps between matches, zoned histograms, group pages, and finds within a scope."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vestige.functions.times import micros_of
from vestige.jobs.event_queries import HOST, events, orders
from vestige.jobs.registry import query, table
from vestige.operators import aggregates as agg
from vestige.operators import order_index, zoned
from vestige.operators import search as find
from vestige.relation import Relation

PLACED = "SELECT *, row_number() OVER (ORDER BY lower(event_type) NULLS LAST, value DESC NULLS LAST, event_id) - 1 AS position, value > 90 AS hit FROM events"
ORDER = ["event_type", "-value"]


def placed(spark, sf_dir):
    return order_index.build(events(spark, sf_dir), ORDER, hit=F.col("value") > 90)


@query("page_deep", f"SELECT event_id, user_id, event_type, props, position, (SELECT count(*) FROM events) > 750 AS has_more FROM ({PLACED}) WHERE position BETWEEN 700 AND 749")
def page_deep(spark, sf_dir):
    """A page from the order index: its partitions alone are read."""
    return placed(spark, sf_dir).page(50, 700).select("event_id", "user_id", "event_type", "props", "position", "has_more")


@query("row_place", f"SELECT position AS place FROM ({PLACED}) WHERE event_id = 321")
def row_place(spark, sf_dir):
    return placed(spark, sf_dir).place(321)


@query("find_steps", f"""WITH m AS (SELECT position, event_id AS row_id, row_number() OVER (ORDER BY position) AS ordinal FROM ({PLACED}) WHERE hit)
SELECT 'next' AS step, * FROM (SELECT * FROM m WHERE position > 500 ORDER BY position LIMIT 20) UNION ALL SELECT 'previous', * FROM (SELECT * FROM m WHERE position < 500 ORDER BY position DESC LIMIT 20)
UNION ALL SELECT 'first', * FROM (SELECT * FROM m ORDER BY position LIMIT 3) UNION ALL SELECT 'last', * FROM (SELECT * FROM m ORDER BY position DESC LIMIT 3)""")
def find_steps(spark, sf_dir):
    """The matches next after a row and before it, the first and the last."""
    index = placed(spark, sf_dir)
    steps = [("next", index.matches(20, 500)), ("previous", index.matches(20, 500, backward=True)), ("first", index.matches(3)), ("last", index.matches(3, backward=True))]
    return find.union([df.select(F.lit(name).alias("step"), "position", "row_id", "ordinal") for name, df in steps])


# Sixty days on, New York's clocks go forward at 2024-03-10 07:00 UTC.
@query("histogram_zoned", """WITH c AS (SELECT epoch_us(TIMESTAMP '2024-03-10 07:00:00') AS turn, 3600000000 AS h),
r AS (SELECT epoch_us(ts) + 5184000000000 AS us, value > 90 AS m FROM events WHERE user_id % 13 <> 0),
k AS (SELECT (us - CASE WHEN us < turn THEN 5 ELSE 4 END * h) // (6 * h) AS k, m, us FROM r, c),
b AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE m) AS marked FROM k GROUP BY k), f AS (SELECT min(k) AS first, max(k) AS last FROM b)
SELECT k - first AS bucket, k * 6 * h + CASE WHEN k * 6 * h + 5 * h < turn THEN 5 ELSE 4 END * h AS start_us, strftime(make_timestamp(k * 6 * h), '%Y-%m-%d %H:%M:%S') AS label, strftime(make_timestamp((k + 1) * 6 * h - 1000000), '%Y-%m-%d %H:%M:%S') AS end_label,
n, marked, 21600 AS width, last - first + 1 AS slots, (SELECT count(*) FROM events WHERE user_id % 13 = 0) AS untimed FROM b, c, f""")
def histogram_zoned(spark, sf_dir):
    """Six-hour buckets on the local clock of New York over a change of its offset, and rows without a time."""
    r = events(spark, sf_dir)
    late = r.with_df(r.df.withColumn("ts", F.when(F.col("user_id") % 13 != 0, F.col("ts") + F.expr("INTERVAL 60 DAYS"))))
    return shown(zoned.histogram(late, 200, "America/New_York", marked=F.col("value") > 90))


def shown(h: zoned.ZonedHistogram):
    return h.buckets.select("*", F.lit(h.width).alias("width"), F.lit(h.slots).cast("long").alias("slots"), F.lit(h.untimed).cast("long").alias("untimed"))


@query("histogram_months", """WITH m AS (SELECT date_trunc('month', o_orderdate + INTERVAL 330 MINUTE) AS m, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS marked FROM orders GROUP BY 1), f AS (SELECT min(m) AS first, max(m) AS last FROM m)
SELECT date_diff('month', first, m) AS bucket, epoch_us(m) - 19800000000 AS start_us, strftime(m, '%Y-%m-%d %H:%M:%S') AS label, strftime(m + INTERVAL 1 MONTH - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS end_label, n, marked,
2592000 AS width, date_diff('month', first, last) + 1 AS slots, 0 AS untimed FROM m, f""")
def histogram_months(spark, sf_dir):
    return shown(zoned.histogram(orders(spark, sf_dir), 100, "Asia/Kolkata", "o_orderdate", marked=F.col("o_totalprice") > 200_000))


MARKED = "SELECT *, CASE WHEN user_id % 10 = 0 THEN 'malicious' WHEN user_id % 10 < 3 THEN 'suspicious' END AS mark, strftime(ts, '%d/%m/%Y %H:%M') AS shown FROM events"


def marked_events(spark, sf_dir) -> Relation:
    r = events(spark, sf_dir)
    mark = F.when(F.col("user_id") % 10 == 0, "malicious").when(F.col("user_id") % 10 < 3, "suspicious")
    df = r.df.withColumns({"_mark": mark, "shown": F.date_format("ts", "dd/MM/yyyy HH:mm")})
    return Relation("events", df, r.host, r.time, r.row_id, r.data, r.typed, {"ts": "shown"})


def _group_sql(key: str, where: str) -> str:
    return f"""SELECT {key} AS key, count(*) AS n, arg_min(shown, ts) AS first_text, arg_max(shown, ts) AS last_text, count(*) FILTER (WHERE mark IS NOT NULL) AS marked FROM ({MARKED}) WHERE {where} GROUP BY 1"""


@query("group_page", f"""WITH g AS ({_group_sql("mark", "TRUE")}), u AS ({_group_sql("user_id::VARCHAR", "mark IS NULL")}), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) - 1 AS position, count(*) OVER () AS total FROM u)
SELECT 'marks' AS level, key, n, first_text, last_text, marked, row_number() OVER (ORDER BY n DESC, key NULLS LAST) - 1 AS position, false AS truncated FROM g
UNION ALL SELECT 'users', key, n, first_text, last_text, marked, position, total > 7 FROM p WHERE position BETWEEN 2 AND 6""")
def group_page(spark, sf_dir):
    """Groups by mark, and a page of users among the rows without one, with the times as their rows show them."""
    r, by = marked_events(spark, sf_dir), ["_mark", "user_id"]
    has = F.col("_mark").isNotNull()
    pages = [("marks", agg.group_page(r, by, marked=has)), ("users", agg.group_page(r, by, {"_mark": None}, has, limit=5, offset=2))]
    return find.union([df.select(F.lit(name).alias("level"), "key", "n", "first_text", "last_text", "marked", "position", "truncated") for name, df in pages])


SCOPE = find.Scope(("1", "4", "5"), datetime(2024, 1, 5), datetime(2024, 1, 6, 12))
IN_SCOPE = f"FROM events WHERE {HOST} IN ('1', '4', '5') AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'"


def searched(spark, sf_dir) -> list[Relation]:
    """Three relations: one has no row in the time asked for, one no time."""
    parts = table(spark, sf_dir, "part").withColumn("host", (F.col("p_partkey") % 7).cast("string"))
    return [events(spark, sf_dir), orders(spark, sf_dir), Relation("parts", parts, "host", None, "p_partkey", ("p_name",))]


@query("find_in_scope", f"""WITH e AS (SELECT {HOST} AS host, event_type, props {IN_SCOPE}), h AS (SELECT host, count(*) AS n FROM e WHERE contains(event_type, 'err') GROUP BY 1)
SELECT 'hit' AS kind, 'events' AS relation, 'event_type' AS "column", host, n FROM h
UNION ALL SELECT 'relation', 'events', 'searched', NULL, coalesce(sum(n), 0)::BIGINT FROM h UNION ALL SELECT 'relation', 'orders', 'searched', NULL, 0 UNION ALL SELECT 'relation', 'parts', 'left out', NULL, 0
UNION ALL SELECT 'host without', NULL, NULL, host, 0 FROM (SELECT DISTINCT host FROM e) WHERE host NOT IN (SELECT host FROM h)""")
def find_in_scope(spark, sf_dir):
    found = find.find_in_scope(searched(spark, sf_dir), "ERR", SCOPE)
    none = F.lit(None).cast("string")
    hits = found.hits.select(F.lit("hit").alias("kind"), "relation", "column", "host", "n")
    relations = found.relations.select(F.lit("relation").alias("kind"), "relation", F.when(F.col("searched"), "searched").otherwise("left out").alias("column"), none.alias("host"), "n")
    unseen = found.hosts_not_seen.select(F.lit("host without").alias("kind"), none.alias("relation"), none.alias("column"), "host", F.lit(0).cast("long").alias("n"))
    return find.union([hits, relations, unseen])


@query("ioc_sightings_by_relation", f"""WITH c AS (SELECT 'events' AS relation, {HOST} AS host, ts AS seen, unnest([event_type, user_id::VARCHAR, props]) AS value {IN_SCOPE}),
w AS (SELECT unnest(['ERROR', '5', 'absent', 'Signup', 'F']) AS value),
m AS (SELECT w.value, relation, count(*) AS hits, count(DISTINCT host) AS hosts, epoch_us(min(seen)) AS first_us, epoch_us(max(seen)) AS last_us FROM c JOIN w ON lower(c.value) = lower(w.value) GROUP BY GROUPING SETS ((w.value, relation), (w.value)))
SELECT * FROM m UNION ALL SELECT value, NULL, 0, 0, NULL, NULL FROM w WHERE value NOT IN (SELECT value FROM m)""")
def ioc_sightings_by_relation(spark, sf_dir):
    wanted = spark.createDataFrame([("ERROR",), ("5",), ("absent",), ("Signup",), ("F",)], "value string")
    out = find.sightings_by_relation(searched(spark, sf_dir), wanted, SCOPE)
    return out.select("value", "relation", "hits", "hosts", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"))
