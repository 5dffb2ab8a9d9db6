"""Filters, groups, stacks, gaps and timelines over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.functions.times import micros_of
from vestige.jobs.registry import query, table
from vestige.operators import aggregates as agg
from vestige.operators import predicates as pred
from vestige.operators import search as find
from vestige.operators import windows as win
from vestige.relation import Relation

HOST = "(user_id % 7)::VARCHAR"


def events(spark: SparkSession, sf_dir: str) -> Relation:
    df = table(spark, sf_dir, "events").withColumn("host", (F.col("user_id") % 7).cast("string"))
    return Relation("events", df, "host", "ts", "event_id", ("event_type", "user_id", "props"), frozenset({"event_id", "user_id", "ts", "value"}))


def orders(spark: SparkSession, sf_dir: str) -> Relation:
    df = table(spark, sf_dir, "orders").withColumn("host", (F.col("o_custkey") % 7).cast("string"))
    return Relation("orders", df, "host", "o_orderdate", "o_orderkey", ("o_orderstatus", "o_orderpriority"), frozenset({"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"}))


def picked(spark: SparkSession, sf_dir: str, doc: dict) -> DataFrame:
    return pred.apply_filter(events(spark, sf_dir), doc).select("event_id")


def leaf(column: str, op: str, value: object = None, **more: object) -> dict:
    return {"col": column, "op": op, "value": value, **more}


FILTERS = {
    "f_eq_ne": ({"or": [leaf("event_type", "eq", "ERROR"), leaf("event_type", "eq", "Click", case_sensitive=True)]}, "lower(event_type) = 'error' OR event_type = 'Click'"),
    "f_ne": (leaf("event_type", "ne", "view"), "NOT coalesce(lower(event_type) = 'view', FALSE)"),
    "f_contains": (
        {"and": [leaf("event_type", "contains", "I"), leaf("event_type", "not_contains", "vie"), {"or": [leaf("props", "starts_with", '{"K'), leaf("props", "ends_with", "7}")]}]},
        "contains(lower(event_type), 'i') AND NOT contains(lower(event_type), 'vie') AND (starts_with(lower(props), '{\"k') OR ends_with(lower(props), '7}'))",
    ),
    "f_literal_wildcards": (leaf("event_type", "contains", "%"), "contains(event_type, '%')"),
    "f_regex": (leaf("event_type", "regex", "^(ERR|si).*"), "regexp_matches(event_type, '(?i)^(err|si).*')"),
    "f_in": ({"and": [leaf("event_type", "in", ["View", "error"]), leaf("user_id", "not_in", ["8", "46"])]}, "lower(event_type) IN ('view', 'error') AND user_id NOT IN (8, 46)"),
    "f_in_empty": (leaf("event_type", "not_in", []), "TRUE"),
    "f_range": ({"or": [leaf("value", "between", [5, 10]), {"and": [leaf("user_id", "gt", 100), leaf("user_id", "lte", 120)]}, leaf("event_type", "gte", "V")]}, "value BETWEEN 5 AND 10 OR (user_id > 100 AND user_id <= 120) OR lower(event_type) >= 'v'"),
    "f_empty": ({"and": [leaf("props", "not_empty"), {"not": leaf("event_type", "is_empty")}]}, "coalesce(props, '') <> '' AND coalesce(event_type, '') <> ''"),
    "filter_doc": (
        {"and": [{"not": {"or": [leaf("event_type", "eq", "view"), leaf("props", "contains", '"k": 1')]}}, {"or": [leaf("value", "lt", 3), {"not": leaf("user_id", "gte", 50)}]}, {"and": []}]},
        "NOT (lower(event_type) = 'view' OR contains(props, '\"k\": 1')) AND (value < 3 OR NOT user_id >= 50)",
    ),
    "filter_empty_or": ({"or": []}, "FALSE"),
    "group_filter": (pred.group_filter({"event_type": "error", "user_id": "8"}), "event_type = 'error' AND user_id = 8"),
}


def _register(name: str, doc: dict, where: str) -> None:
    query(name, f"SELECT event_id FROM events WHERE {where}")(lambda spark, sf_dir: picked(spark, sf_dir, doc))


for _name, (_doc, _where) in FILTERS.items():
    _register(_name, _doc, _where)


def anywhere(text: str, cells: tuple[str, ...] = ("event_type", "user_id::VARCHAR", "props", HOST)) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{text}')" for c in cells) + ")"


#: What is typed into the box, and the same as a condition.
SEARCHES = {
    "search_box": ('Event_Type:ERR +user_id:4 -purchase props:"{""k"": 7"', "(contains(lower(event_type), 'err') OR contains(props, '{k: 7')) AND contains(user_id::VARCHAR, '4') AND NOT " + anywhere("purchase")),
    "search_box_terms": ('sign event_type:rror +props:": 1"', f"({anywhere('sign')} OR contains(lower(event_type), 'rror')) AND contains(lower(props), ': 1')"),
    "search_box_columns": ("HOST:3 ts:2024-01-1 -EVENT_TYPE:view -value:9.", f"(contains({HOST}, '3') OR contains(strftime(ts, '%Y-%m-%d %H:%M:%S'), '2024-01-1')) AND NOT contains(event_type, 'view') AND NOT contains(value::VARCHAR, '9.')"),
    "search_box_blank": ('  "" +"" ', "TRUE"),
}


def _register_search(name: str, text: str, where: str) -> None:
    def run(spark, sf_dir):
        r = events(spark, sf_dir)
        return r.df.where(pred.search(text, r)).select("event_id")

    query(name, f"SELECT event_id FROM events WHERE {where}")(run)


for _name, (_text, _where) in SEARCHES.items():
    _register_search(_name, _text, _where)


NOTE_SQL = "CASE user_id % 4 WHEN 0 THEN 'See http://x/' || user_id WHEN 1 THEN 'note:see ' || event_type WHEN 2 THEN 'event_type:' || event_type || ' +1' END"


@query("search_box_text", f"""WITH e AS (SELECT event_id, coalesce(lower({NOTE_SQL}), '') AS note, event_type FROM events)
SELECT event_id FROM e WHERE (contains(note, 'http://x') OR contains(note, 'see v') OR contains(note, 'event_type:error') OR contains(note, '+1')) AND NOT contains(note, '/4') AND NOT contains(note, 'type:view')""")
def search_box_text(spark, sf_dir):
    """Terms with colons and signs: ``Note`` is a column, whatever its case, ``http`` and a name in quotes are none."""
    r = events(spark, sf_dir)
    kind = F.col("user_id") % 4
    note = F.when(kind == 0, F.concat(F.lit("See http://x/"), "user_id")).when(kind == 1, F.concat(F.lit("note:see "), "event_type")).when(kind == 2, F.concat(F.lit("event_type:"), "event_type", F.lit(" +1")))
    with_note = Relation("events", r.df.withColumn("Note", note), None, "ts", "event_id", ("Note",), r.typed)
    return with_note.df.where(pred.search('http://x note:"see v" "event_type":error "+1" -Note:/4 -type:view', with_note)).select("event_id")


@query("search_box_regex", f"""SELECT event_id, regexp_matches(event_type, '(?i)^(ERR|si).*') OR regexp_matches(user_id::VARCHAR, '(?i)^(ERR|si).*') OR regexp_matches(props, '(?i)^(ERR|si).*') OR regexp_matches({HOST}, '(?i)^(ERR|si).*') AS folded,
regexp_matches(event_type, '^1[0-9]$|^View$') OR regexp_matches(user_id::VARCHAR, '^1[0-9]$|^View$') OR regexp_matches(props, '^1[0-9]$|^View$') OR regexp_matches({HOST}, '^1[0-9]$|^View$') AS exact FROM events""")
def search_box_regex(spark, sf_dir):
    """The whole text as a pattern on each cell by itself."""
    r = events(spark, sf_dir)
    return r.df.select("event_id", pred.search("^(ERR|si).*", r, regex=True).alias("folded"), pred.search("^1[0-9]$|^View$", r, regex=True, case_sensitive=True).alias("exact"))


@query("event_filter", "SELECT event_id FROM events WHERE contains(lower(event_type), 'i') AND user_id IN (1, 2, 3, 4, 5) AND user_id NOT IN (3) AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def event_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(win.event_filter("event_type", "user_id", "ts", "I", [1, 2, 3, 4, 5], [3], "2024-01-05 00:00:00", "2024-01-20 00:00:00")).select("event_id")


@query("f_hosts", f"SELECT event_id FROM events WHERE {HOST} IN ('1', '4')")
def f_hosts(spark, sf_dir):
    r = events(spark, sf_dir)
    return r.df.where(F.col("host").isin(pred.pick_hosts([str(i) for i in range(7)], ["1", "4"]))).select("event_id")


@query("date_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-09 23:00:00' AND ts < TIMESTAMP '2024-01-12 11:00:01'")
def date_range(spark, sf_dir):
    return table(spark, sf_dir, "events").where(win.wall_clock_range("ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00", "Europe/Berlin")).select("event_id")


@query("colour_rule", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 1 WHEN event_type = 'error' THEN 2 WHEN user_id < 10 THEN 3 END AS rule_id FROM events")
def colour_rule(spark, sf_dir):
    r = events(spark, sf_dir)
    rules = [(1, {"and": [leaf("event_type", "eq", "error"), leaf("value", "gt", 50)]}), (2, leaf("event_type", "eq", "error")), (3, leaf("user_id", "lt", 10))]
    return r.df.select("event_id", pred.colour(rules, r).alias("rule_id"))


@query("groups", "SELECT event_type AS key, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) FILTER (WHERE value > 90) AS marked FROM events GROUP BY 1")
def groups(spark, sf_dir):
    return agg.groups(events(spark, sf_dir), ["event_type", "user_id"], marked=F.col("value") > 90).select("key", "n", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"), "marked")


@query("groups_level_two", "SELECT user_id::VARCHAR AS key, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def groups_level_two(spark, sf_dir):
    return agg.groups(events(spark, sf_dir), ["event_type", "user_id"], {"event_type": "error"}).select("key", "n")


STACK_SQL = "SELECT event_type, user_id::VARCHAR AS user_id, count(*) AS n, count(DISTINCT user_id % 7) AS hosts, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) FILTER (WHERE value > 90) AS marked FROM events GROUP BY 1, 2"


@query("stack", STACK_SQL)
def stack(spark, sf_dir):
    by = ["event_type", "user_id"]
    out = agg.rarest(agg.stack(events(spark, sf_dir), by, F.col("value") > 90), by)
    return out.select(*by, "n", "hosts", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"), "marked")


@query("stack_totals", "SELECT count(*) AS n, count(DISTINCT event_type || '/' || user_id) AS combinations, count(DISTINCT user_id % 7) AS hosts FROM events")
def stack_totals(spark, sf_dir):
    return agg.stack_totals(events(spark, sf_dir), ["event_type", "user_id"])


@query("values", "SELECT user_id::VARCHAR AS value, count(*) AS n FROM events WHERE contains(user_id::VARCHAR, '7') GROUP BY 1")
def values(spark, sf_dir):
    return agg.values(events(spark, sf_dir), "user_id", "7")


@query(
    "histogram",
    """WITH e AS (SELECT floor(epoch_us(min(ts)) / 1000000.0)::BIGINT AS a, floor(epoch_us(max(ts)) / 1000000.0)::BIGINT AS b FROM events),
    w AS (SELECT min(width) AS width FROM e, (SELECT unnest([1, 10, 60, 300, 900, 3600, 21600, 86400, 604800, 2592000]) AS width) WHERE b // width - a // width + 1 <= 100),
    s AS (SELECT floor(epoch_us(ts) / 1000000.0)::BIGINT AS sec, value FROM events),
    f AS (SELECT min(sec) AS low FROM s)
    SELECT sec // width - low // width AS bucket, sec // width * width AS start_second, count(*) AS n, count(*) FILTER (WHERE value > 90) AS marked FROM s, w, f GROUP BY ALL""",
)
def histogram(spark, sf_dir):
    return win.histogram(events(spark, sf_dir), 100, F.col("value") > 90)


@query("count_view", "SELECT count(*) FILTER (WHERE event_type = 'error') AS selected, count(*) AS total, 0::BIGINT AS failed_cells FROM events")
def count_view(spark, sf_dir):
    r = events(spark, sf_dir)
    return agg.count_view(r, pred.compile_filter(leaf("event_type", "eq", "error"), r))


@query("empty_columns", "SELECT 'empty' AS \"column\"")
def empty_columns(spark, sf_dir):
    r = events(spark, sf_dir)
    return agg.empty_columns(Relation("events", r.df.withColumn("empty", F.lit("")), data=("event_type", "empty", "props")))


@query("coverage_by_dataset", "SELECT 'events' AS dataset, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events UNION ALL SELECT 'orders', count(*), epoch_us(min(o_orderdate)), epoch_us(max(o_orderdate)) FROM orders")
def coverage_by_dataset(spark, sf_dir):
    parts = []
    for r in (events(spark, sf_dir), orders(spark, sf_dir)):
        parts.append(r.df.agg(F.count("*").alias("n"), micros_of(F.min(r.time)).alias("first_us"), micros_of(F.max(r.time)).alias("last_us")).select(F.lit(r.name).alias("dataset"), "n", "first_us", "last_us"))
    return find.union(parts)


@query("rows_per_user", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def rows_per_user(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("cast_health", "SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(h, '') = '') AS blank, count(try_cast(h AS BIGINT)) AS converted, count(*) FILTER (WHERE coalesce(h, '') <> '' AND try_cast(h AS BIGINT) IS NULL) AS failed FROM (SELECT CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN event_type ELSE user_id::VARCHAR END AS h FROM events)")
def cast_health(spark, sf_dir):
    text = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    df = table(spark, sf_dir, "events").select(text.alias("h__text")).withColumn("h", F.col("h__text").try_cast("bigint"))
    return agg.cast_health(Relation("events", df, typed=frozenset({"h"}), text={"h": "h__text"}), "h")


@query("f_conversion_failed", "SELECT event_id FROM events WHERE user_id % 3 = 1")
def f_conversion_failed(spark, sf_dir):
    text = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    df = table(spark, sf_dir, "events").select("event_id", text.alias("h__text")).withColumn("h", F.col("h__text").try_cast("bigint"))
    r = Relation("events", df, typed=frozenset({"h"}), text={"h": "h__text"})
    return df.where(pred.compile_filter(leaf("h", "conversion_failed"), r)).select("event_id")


@query(
    "stack_processes",
    """WITH c AS (SELECT user_id % 7 AS host, event_type, user_id % 4 AS level, count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT host, event_type, sum(n)::BIGINT AS n, string_agg(level || ' (' || n || ')', ' | ' ORDER BY n DESC, level::VARCHAR) AS levels FROM c GROUP BY 1, 2""",
)
def stack_processes(spark, sf_dir):
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("host"), "event_type", (F.col("user_id") % 4).cast("string").alias("level"))
    return agg.counted_list(df, ["host", "event_type"], "level", "levels")


@query("list_distinct", "SELECT DISTINCT regexp_extract(props, '\"k\": (\\d+)', 1) AS item FROM events")
def list_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.regexp_extract("props", r'"k": (\d+)', 1).alias("item")).distinct()


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("blackout_gaps", "SELECT * FROM (SELECT event_type, host, epoch_us(lag(ts) OVER w) AS from_us, epoch_us(ts) AS to_us, date_diff('hour', lag(ts) OVER w, ts) AS hours FROM (SELECT *, user_id % 7 AS host FROM events) WINDOW w AS (PARTITION BY event_type, host ORDER BY ts, event_id)) WHERE hours >= 6")
def blackout_gaps(spark, sf_dir):
    r = events(spark, sf_dir)
    gaps = win.blackout_gaps(r.with_df(r.df.withColumn("host", F.col("user_id") % 7)), ["event_type", "host"], 6)
    return gaps.select("event_type", "host", micros_of(F.col("before")).alias("from_us"), micros_of(F.col("after")).alias("to_us"), "hours")


@query("record_gaps", "SELECT host, before + 1 AS first_missing, event_id - 1 AS last_missing, event_id - before - 1 AS n FROM (SELECT user_id % 7 AS host, event_id, lag(event_id) OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS before FROM events) WHERE event_id - before > 1")
def record_gaps(spark, sf_dir):
    return win.record_gaps(table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("host"), "event_id"), "host", "event_id")


FIND_SQL = f"""WITH cells AS (
  SELECT 'events' AS relation, unnest(['event_type', 'user_id', 'props']) AS "column", {HOST} AS host, ts AS seen_at, unnest([event_type, user_id::VARCHAR, props]) AS value FROM events
  UNION ALL SELECT 'orders', unnest(['o_orderstatus', 'o_orderpriority']), (o_custkey % 7)::VARCHAR, o_orderdate, unnest([o_orderstatus, o_orderpriority]) FROM orders)
SELECT relation, "column", host, count(*) AS n, epoch_us(min(seen_at)) AS first_us, epoch_us(max(seen_at)) AS last_us FROM cells WHERE contains(lower(value), 'er') GROUP BY 1, 2, 3"""


@query("find_everywhere", FIND_SQL)
def find_everywhere(spark, sf_dir):
    hits = find.find_everywhere([events(spark, sf_dir), orders(spark, sf_dir)], "ER")
    return hits.select("relation", "column", "host", "n", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"))


@query("find_hosts_not_seen", f"SELECT DISTINCT {HOST} AS host FROM events WHERE {HOST} NOT IN (SELECT {HOST} FROM events WHERE user_id = 46)")
def find_hosts_not_seen(spark, sf_dir):
    r = [events(spark, sf_dir)]
    return find.hosts_not_seen(r, find.find_everywhere(r, "46", exact=True))


@query("ioc_sightings", f"SELECT w.value, count(*) AS hits, count(DISTINCT host) AS hosts, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM (SELECT {HOST} AS host, ts, unnest([event_type, user_id::VARCHAR, props]) AS value FROM events) c JOIN (SELECT unnest(['ERROR', '46', 'absent', 'Signup']) AS value) w ON lower(c.value) = lower(w.value) GROUP BY 1")
def ioc_sightings(spark, sf_dir):
    wanted = spark.createDataFrame([("ERROR",), ("46",), ("absent",), ("Signup",)], "value string")
    out = find.sightings([events(spark, sf_dir)], wanted)
    return out.select("value", "hits", "hosts", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"))


@query("ioc_flags", "SELECT event_id, event_type = 'error' OR event_type = 'signup' AS flagged FROM events")
def ioc_flags(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", find.ascii_fold(F.col("event_type")).isin("error", "signup").alias("flagged"))


@query("around", f"SELECT 'events' AS relation, count(*) AS n FROM events WHERE {HOST} = '3' AND ts BETWEEN TIMESTAMP '2024-01-09 22:00:00' AND TIMESTAMP '2024-01-10 02:00:00' UNION ALL SELECT 'orders', count(*) FROM orders WHERE (o_custkey % 7)::VARCHAR = '3' AND o_orderdate BETWEEN TIMESTAMP '2024-01-09 22:00:00' AND TIMESTAMP '2024-01-10 02:00:00'")
def around(spark, sf_dir):
    low, high = (F.to_timestamp_ntz(F.lit(t)) for t in ("2024-01-09 22:00:00", "2024-01-10 02:00:00"))
    return find.around([events(spark, sf_dir), orders(spark, sf_dir)], "3", low, high)


@query("around_anchors", "SELECT a.event_id AS anchor_id, b.event_id FROM events a JOIN events b ON a.user_id % 7 = b.user_id % 7 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000 WHERE a.event_type = 'purchase'")
def around_anchors(spark, sf_dir):
    r = events(spark, sf_dir)
    anchors = r.df.where("event_type = 'purchase'").select(F.col("event_id").alias("anchor_id"), "host", F.col("ts").alias("at"))
    return find.around_anchors(r, anchors, 60).select("anchor_id", "event_id")


@query("merged_rows", """SELECT relation, row_id, at_us, summary, row_number() OVER (ORDER BY at_us NULLS LAST, relation, row_id) - 1 AS position FROM (SELECT * FROM (SELECT 'events' AS relation, event_id::VARCHAR AS row_id, epoch_us(ts) AS at_us, event_type || ' · ' || user_id || ' · ' || props AS summary FROM events WHERE event_type = 'error'
UNION ALL SELECT 'orders', o_orderkey::VARCHAR, epoch_us(o_orderdate), o_orderstatus || ' · ' || o_orderpriority FROM orders WHERE o_orderstatus = 'P') ORDER BY at_us NULLS LAST, relation, row_id LIMIT 500)""")
def merged_rows(spark, sf_dir):
    out = find.merged_rows([events(spark, sf_dir), orders(spark, sf_dir)], {"events": F.col("event_type") == "error", "orders": F.col("o_orderstatus") == "P"}, 500)
    return out.select("relation", "row_id", micros_of(F.col("seen_at")).alias("at_us"), "summary", "position")


PAGE_SQL = """SELECT event_id, event_type[:2000] AS event_type, user_id, position, failed, position + 1 < (SELECT count(*) FROM events WHERE event_type = 'error') AND {last} AS has_more
FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'value' ELSE '' END AS failed, row_number() OVER (ORDER BY CASE WHEN user_id % 5 <> 0 THEN value END {way} NULLS LAST, event_id) - 1 AS position FROM events WHERE event_type = 'error') WHERE position >= {offset} AND position < {offset} + 100"""


def paged(spark, sf_dir, order, offset):
    """Events whose value has text but failed to convert for some users, so that nulls are sorted and flagged."""
    r = events(spark, sf_dir)
    df = r.df.withColumn("value__text", F.col("value").cast("string")).withColumn("value", F.when(F.col("user_id") % 5 != 0, F.col("value")))
    r = Relation("events", df, "host", "ts", "event_id", ("event_type", "props"), r.typed, {"value": "value__text"})
    out = win.page(r, pred.compile_filter(leaf("event_type", "eq", "error"), r), order, 100, offset)
    return out.select("event_id", "event_type", "user_id", "position", F.array_join("failed", ",").alias("failed"), "has_more")


@query("page", PAGE_SQL.format(way="", offset=200, last="(SELECT count(*) FROM events WHERE event_type = 'error') > 300"))
def page(spark, sf_dir):
    return paged(spark, sf_dir, ["value"], 200)


@query("page_descending", PAGE_SQL.format(way="DESC", offset=0, last="(SELECT count(*) FROM events WHERE event_type = 'error') > 100"))
def page_descending(spark, sf_dir):
    return paged(spark, sf_dir, ["-value"], 0)


@query("row_offset", "SELECT count(*) AS place FROM (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN value END AS v FROM events) WHERE v < (SELECT value FROM events WHERE event_id = 4321) OR v = (SELECT value FROM events WHERE event_id = 4321) AND event_id < 4321 OR (SELECT user_id % 5 = 0 FROM events WHERE event_id = 4321) AND (v IS NOT NULL OR event_id < 4321)")
def row_offset(spark, sf_dir):
    r = events(spark, sf_dir)
    return win.row_offset(r.with_df(r.df.withColumn("value", F.when(F.col("user_id") % 5 != 0, F.col("value")))), "value", 4321)


@query("find_matches", "SELECT * FROM (SELECT event_id, props, row_number() OVER (ORDER BY ts, event_id) AS position, event_type = 'error' AS hit, CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY event_type = 'error' ORDER BY ts, event_id) END AS ordinal FROM events)")
def find_matches(spark, sf_dir):
    return win.numbered(table(spark, sf_dir, "events"), ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "props", "position", "hit", "ordinal")


@query("row_occurrence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS occurrence FROM orders")
def row_occurrence(spark, sf_dir):
    return win.occurrences(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey").select("o_orderkey", "occurrence")


@query("shimcache_duplicates", "SELECT event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) > 1 AS duplicate FROM events")
def shimcache_duplicates(spark, sf_dir):
    return win.repeats(table(spark, sf_dir, "events"), ["user_id", "props"], "event_id").select("event_id", "duplicate")
