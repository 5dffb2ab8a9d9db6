"""Reports and timelines over the given tables; cells that a report takes apart are made odd on purpose: null, blank, cut, repeated."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions import text as tx
from vestige.functions.times import differing, micros_of
from vestige.jobs.registry import query, table
from vestige.operators import artifacts as art
from vestige.operators import timelines as tl
from vestige.operators.artifacts import Step
from vestige.operators.timelines import Leg
from vestige.operators.windows import ntz


def case(c, *values):
    """The value whose place is ``c``; the last one for all further places."""
    out = F.when(c == 0, values[0])
    for i, value in enumerate(values[1:-1], 1):
        out = out.when(c == i, value)
    return out.otherwise(values[-1])


# Rows that point to others --------------------------------------------------


@query("keyword_searches", "SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, CASE WHEN o_orderkey IS NULL THEN 'no url' WHEN c_custkey IS NULL THEN 'no visit' ELSE '' END AS note FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey")
def keyword_searches(spark, sf_dir):
    urls = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus")
    visits = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    terms = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return art.follow(terms, Step(urls, {"l_orderkey": "o_orderkey"}, "no url"), Step(visits, {"o_custkey": "c_custkey"}, "no visit")).drop("o_custkey")


@query("bookmarks_places", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 3) ON c_nationkey = n_nationkey")
def bookmarks_places(spark, sf_dir):
    places = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select("c_custkey", "c_name", "c_nationkey")
    words = table(spark, sf_dir, "nation").where("n_nationkey > 3").select("n_nationkey", "n_name")
    marks = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return art.follow(marks, Step(places, {"o_custkey": "c_custkey"}), Step(words, {"c_nationkey": "n_nationkey"})).select("o_orderkey", "c_name", "n_name")


@query("firefox_searches", "SELECT event_id, c_name, n_name, CASE WHEN c_custkey IS NULL THEN 'no metadata' WHEN n_nationkey IS NULL THEN 'no place' ELSE '' END AS note FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON user_id = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 5) ON c_nationkey = n_nationkey WHERE event_type = 'click'")
def firefox_searches(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_nationkey")
    places = table(spark, sf_dir, "nation").where("n_nationkey <> 5").select("n_nationkey", "n_name")
    asked = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id")
    return art.follow(asked, Step(meta, {"user_id": "c_custkey"}, "no metadata"), Step(places, {"c_nationkey": "n_nationkey"}, "no place")).select("event_id", "c_name", "n_name", "note")


@query("notifications_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def notifications_join(spark, sf_dir):
    handlers = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_nationkey")
    channels = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return art.follow(rows, Step(handlers, {"o_custkey": "c_custkey"}, required=True), Step(channels, {"c_nationkey": "n_nationkey"})).select("o_orderkey", "c_name", "n_name")


@query("office_reading", "SELECT l_orderkey, l_linenumber, epoch_us(o_orderdate) AS closed_us FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def office_reading(spark, sf_dir):
    locations = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", micros_of(F.col("o_orderdate")).alias("closed_us"))
    return art.follow(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), Step(locations, {"l_orderkey": "o_orderkey"})).drop("note")


@query("icon_pages", "SELECT DISTINCT p_partkey, s_name FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey")
def icon_pages(spark, sf_dir):
    icons, pages = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return art.across(icons, table(spark, sf_dir, "lineitem"), pages, ("p_partkey", "l_partkey"), ("l_suppkey", "s_suppkey")).select("p_partkey", "s_name").distinct()


@query("typed_urls", "SELECT o_orderkey, CASE WHEN event_id % 6 <> 0 THEN epoch_us(ts) END AS typed_us FROM orders LEFT JOIN events ON o_orderkey = event_id")
def typed_urls(spark, sf_dir):
    at = F.when(F.col("event_id") % 6 == 0, F.lit(art.UNSET)).otherwise(micros_of(F.col("ts")))
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey"), at.alias("typed_us"))
    return art.typed_urls(table(spark, sf_dir, "orders").select("o_orderkey"), times, ["o_orderkey"], "typed_us")


@query("app_packages", "SELECT c_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS display, max(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS folder FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def app_packages(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    return art.with_values(table(spark, sf_dir, "customer").select("c_custkey"), values, "c_custkey", "o_orderstatus", "o_orderpriority", {"F": "display", "O": "folder"})


@query("folder_expand", """SELECT p_partkey, CASE WHEN n_name IS NOT NULL AND p_partkey % 4 <> 1 AND p_partkey % 4 <> 3 THEN n_name || CASE p_partkey % 4 WHEN 0 THEN '\\a.exe' ELSE '\\B\\' || p_name || '.exe' END ELSE '' END AS expanded FROM part LEFT JOIN nation ON n_nationkey = p_size""")
def folder_expand(spark, sf_dir):
    guid = F.concat(F.lit("{AB-"), F.col("p_size").cast("string"), F.lit("}"))
    # A program, no program, a program deeper down, and none at all.
    path = case(F.col("p_partkey") % 4, F.concat(guid, F.lit("\\a.exe")), F.concat(guid, F.lit("\\a.txt")), F.concat(guid, F.lit("\\B\\"), "p_name", F.lit(".exe")), F.lit(None))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("{ab-"), F.col("n_nationkey").cast("string"), F.lit("}")).alias("guid"), F.col("n_name").alias("folder"))
    return art.expand_folders(table(spark, sf_dir, "part").select("p_partkey", path.alias("path")), "path", known).select("p_partkey", "expanded")


# Searches and facts ---------------------------------------------------------


@query("registry_search", "SELECT p_partkey, 'key' AS hit_type FROM part WHERE contains(lower(p_name), 'red') UNION ALL SELECT p_partkey, 'value' FROM part WHERE contains(lower(p_type), 'red') UNION ALL SELECT p_partkey, 'data' FROM part WHERE contains(lower(p_brand), 'red')")
def registry_search(spark, sf_dir):
    return art.registry_hits(table(spark, sf_dir, "part"), {"key": "p_name", "value": "p_type", "data": "p_brand"}, art.holds("RED")).select("p_partkey", "hit_type")


@query("registry_search_regex", "SELECT p_partkey, 'key' AS hit_type FROM part WHERE regexp_matches(lower(p_name), 'r.d|^b') UNION ALL SELECT p_partkey, 'data' FROM part WHERE regexp_matches(lower(p_brand), 'r.d|^b')")
def registry_search_regex(spark, sf_dir):
    return art.registry_hits(table(spark, sf_dir, "part"), {"key": "p_name", "data": "p_brand"}, art.holds("R.D|^b", regex=True)).select("p_partkey", "hit_type")


@query("prefetch_keywords", "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))")
def prefetch_keywords(spark, sf_dir):
    lists = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.array("p_name", F.lit(None))).alias("files"), F.when(F.col("p_partkey") % 5 != 0, F.array("p_type")).alias("folders"))
    return art.with_keyword(lists, ["files", "folders"], "RING").select("p_partkey")


@query("fields_config", """WITH h AS (SELECT DISTINCT c_nationkey AS host FROM customer), f AS (SELECT unnest(['Machinery', 'Even', 'Absent']) AS label),
x AS (SELECT c_nationkey AS host, 'Machinery' AS label, arg_min(c_name, c_custkey) AS fact FROM customer WHERE ends_with(c_mktsegment, 'CHINERY') AND c_custkey % 2 = 1 GROUP BY 1
UNION ALL SELECT c_nationkey, 'Even', arg_min(c_name, c_custkey) FROM customer WHERE ends_with(c_mktsegment, 'ING') AND c_custkey % 2 = 0 GROUP BY 1)
SELECT host, label, coalesce(fact, '(not found)') AS fact FROM (SELECT * FROM h, f) LEFT JOIN x USING (host, label)""")
def fields_config(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("host"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("which"), "c_name", "c_custkey")
    return art.host_facts(rows, "host", "c_mktsegment", "which", "c_name", "c_custkey", [("Machinery", "CHINERY", "odd"), ("Even", "ING", "even"), ("Absent", "NONE", "odd")])


@query("profile_list", "SELECT DISTINCT c_nationkey AS host, c_mktsegment AS sid, 'C:\\Users\\' || c_custkey % 3 AS profile FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0")
def profile_list(spark, sf_dir):
    key = F.concat(F.when(F.col("c_custkey") % 7 == 0, "Key: ").otherwise("KeyName: "), "c_mktsegment")
    image = F.concat(F.lit("ProfileImagePath: C:\\Users\\"), (F.col("c_custkey") % 3).cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("host"), F.lit("ROOT\\ProfileList").alias("path"), F.when(F.col("c_custkey") % 4 != 0, "Multiple").alias("name"), key.alias("key"), image.alias("image"))
    return art.profiles(rows, "host", "path", "name", "key", "image")


@query("group_concat_accounts", "SELECT c_nationkey, c_mktsegment, string_agg(DISTINCT (c_custkey % 9)::VARCHAR, ', ' ORDER BY (c_custkey % 9)::VARCHAR) AS accounts FROM customer GROUP BY 1, 2")
def group_concat_accounts(spark, sf_dir):
    return art.listed(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], (F.col("c_custkey") % 9).cast("string"), "accounts")


# Events ---------------------------------------------------------------------


@query("log_cleared", "SELECT event_id FROM events WHERE (user_id % 3 = 0 AND event_type = 'error') OR (user_id % 3 = 1 AND event_type IN ('signup', 'purchase'))")
def log_cleared(spark, sf_dir):
    channel = case(F.col("user_id") % 3, F.lit("Security"), F.lit("System"), F.lit(None))
    code = tx.code_name(F.col("event_type"), {"error": 1102, "signup": 104, "purchase": 1100}, F.lit(None)).cast("int")
    return art.log_cleared(table(spark, sf_dir, "events").select("event_id", "ts", channel.alias("channel"), code.alias("code")), "channel", "code", "ts").select("event_id")


@query("channel_coverage", "SELECT event_type, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, date_diff('day', min(ts), max(ts)) AS days FROM events GROUP BY 1")
def channel_coverage(spark, sf_dir):
    found = tl.coverage(table(spark, sf_dir, "events"), {"event_type": F.col("event_type")}, "ts")
    return found.select("event_type", "n", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"), "days")


@query("event_id_map", "SELECT event_type, user_id % 5 AS event_code, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def event_id_map(spark, sf_dir):
    found = tl.coverage(table(spark, sf_dir, "events").where("event_type <> 'view'"), {"event_type": F.col("event_type"), "event_code": F.col("user_id") % 5}, "ts")
    return found.select("event_type", "event_code", "n", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"))


def details():
    """Packed cells: a field in the middle, at the end, and missing."""
    return F.concat(F.lit("Svc: "), "event_type", F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit(" ¦ Path: p"), (F.col("user_id") % 4).cast("string"), F.when(F.col("user_id") % 2 == 0, " ¦ Acct: x").otherwise(""))))


@query("stack_services", "SELECT user_id % 7 AS host, event_type AS service, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'p' || user_id % 4 END AS path, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2, 3")
def stack_services(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).withColumn("details", details())
    return art.counted(rows, {"host": F.col("user_id") % 7, "service": tx.packed_field(F.col("details"), "Svc"), "path": tx.packed_field(F.col("details"), "Path")})


@query("packed_fields", "SELECT event_id, event_type AS service, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'p' || user_id % 4 END AS path, CASE WHEN user_id % 4 = 2 THEN 'x' ELSE '' END AS account FROM events")
def packed_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", details().alias("details"))
    return rows.select("event_id", *[tx.packed_field(F.col("details"), key).alias(name) for key, name in (("Svc", "service"), ("Path", "path"), ("Acct", "account"))])


USER = "CASE user_id % 10 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'ANONYMOUS LOGON' WHEN 2 THEN 'WS01$' WHEN 3 THEN NULL ELSE event_type END"


def logons(spark, sf_dir):
    user = case(F.col("user_id") % 10, F.lit("SYSTEM"), F.lit("ANONYMOUS LOGON"), F.lit("WS01$"), F.lit(None), F.col("event_type"))
    return table(spark, sf_dir, "events").withColumn("user", user)


@query("stack_logons", f"SELECT user_id % 7 AS host, {USER} AS \"user\", count(*) AS n FROM events WHERE user_id % 10 > 2 GROUP BY 1, 2")
def stack_logons(spark, sf_dir):
    return art.stack_logons(logons(spark, sf_dir), "user", {"host": F.col("user_id") % 7, "user": F.col("user")})


@query("stack_logons_unfiltered", f"SELECT {USER} AS \"user\", event_type = 'error' AS failed, count(*) AS n FROM events GROUP BY 1, 2")
def stack_logons_unfiltered(spark, sf_dir):
    return art.stack_logons(logons(spark, sf_dir), "user", {"user": F.col("user"), "failed": F.col("event_type") == "error"}, filtered=False)


SUMMARY_SQL = """SELECT CASE WHEN event_id % 6 IN (0, 5) THEN 'Dom' || user_id % 3 END AS domain, CASE WHEN event_id % 6 IN (0, 1, 2, 5) THEN 'User' || user_id % 11 END AS account, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome,
CASE event_id % 5 WHEN 0 THEN 3::BIGINT WHEN 1 THEN 10::BIGINT END AS logon_type, user_id % 7 AS host, count(*) AS n FROM events WHERE event_type IN ('error', 'signup', 'click') GROUP BY ALL"""


def summary_of_logons(spark, sf_dir):
    name, domain = F.concat(F.lit("User"), (F.col("user_id") % 11).cast("string")), F.concat(F.lit("Dom"), (F.col("user_id") % 3).cast("string"))
    # With a domain, without, with none but a dash, no account, another text, and a domain again.
    qualified = F.concat(F.lit("Target: "), domain, F.lit("\\"), name)
    target = case(F.col("event_id") % 6, qualified, F.concat(F.lit("Target: "), name), F.concat(F.lit("Target: -\\"), name), F.lit("Target: -"), F.lit("Source: x"), qualified)
    kind = case(F.col("event_id") % 5, F.lit("LogonType 3"), F.lit("LogonType 10"), F.lit("LogonType 3 x"), F.lit("LogonType 99999999999999999999999999999999999999999"), F.lit(None))
    code = tx.code_name(F.col("event_type"), {"error": 4625, "signup": 4624, "click": 4624}, F.lit(None)).cast("int")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("host"), code.alias("code"), target.alias("target"), kind.alias("kind"))
    return art.logon_summary(rows, "host", "code", "target", "kind")


@query("logon_summary", SUMMARY_SQL)
def logon_summary(spark, sf_dir):
    return summary_of_logons(spark, sf_dir)


@query("logon_summary_accounts", f"""WITH s AS ({SUMMARY_SQL}), a AS (SELECT c_custkey AS account_id, 'USER' || c_custkey % 13 AS name, CASE WHEN c_custkey % 2 = 0 THEN 'DOM' || c_custkey % 4 END AS domain FROM customer)
SELECT account_id, outcome, logon_type, host, sum(n)::BIGINT AS n FROM s JOIN a ON lower(account) = lower(name) AND (a.domain IS NULL OR lower(a.domain) = lower(s.domain)) GROUP BY ALL""")
def logon_summary_accounts(spark, sf_dir):
    key = F.col("c_custkey")
    accounts = table(spark, sf_dir, "customer").select(key.alias("account_id"), F.concat(F.lit("USER"), (key % 13).cast("string")).alias("name"), F.when(key % 2 == 0, F.concat(F.lit("DOM"), (key % 4).cast("string"))).alias("domain"))
    return art.account_logons(summary_of_logons(spark, sf_dir), accounts)


# Timelines ------------------------------------------------------------------


@query("cross_timeline", "SELECT * FROM (SELECT 'log' AS leg, event_id AS id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error' UNION ALL SELECT 'execution', event_id, epoch_us(ts) FROM events WHERE event_type = 'signup' UNION ALL SELECT 'orders', o_orderkey, epoch_us(o_orderdate) FROM orders) WHERE at_us BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-01-11')")
def cross_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    legs = [Leg("log", rows.where("event_type = 'error'"), "event_id", "ts"), Leg("execution", rows.where("event_type = 'signup'"), "event_id", "ts"), Leg("orders", table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")]
    return tl.cross_timeline(legs, ntz("2024-01-10 00:00:00"), ntz("2024-01-11 00:00:00")).select("leg", "id", micros_of(F.col("at")).alias("at_us"))


@query("binary_everywhere", "SELECT 'pages' AS leg, page_id AS id, NULL::BIGINT AS at_us FROM pages WHERE lower(regexp_extract(url, '[^\\\\/]*$', 0)) = '7' UNION ALL SELECT 'events', event_id, epoch_us(ts) FROM events WHERE event_type = 'error' AND user_id % 10 = 7 UNION ALL SELECT 'orders', o_orderkey, epoch_us(o_orderdate) FROM orders WHERE o_custkey = 7")
def binary_everywhere(spark, sf_dir):
    seen = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("name", (F.col("user_id") % 10).cast("string"))
    legs = [
        Leg("pages", table(spark, sf_dir, "pages").withColumn("name", tx.basename(F.col("url"))), "page_id", None, "name"),
        Leg("events", seen, "event_id", "ts", "name"),
        Leg("orders", table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", "o_custkey"),
    ]
    return tl.everywhere(legs, "7").select("leg", "id", micros_of(F.col("at")).alias("at_us"))


@query("browser_timeline", "SELECT o_orderkey AS id, 'ordered' AS type, epoch_us(o_orderdate) AS at_us FROM orders UNION ALL SELECT l_orderkey, 'shipped', epoch_us(l_shipdate) FROM lineitem UNION ALL SELECT l_orderkey, 'billed', epoch_us(l_shipdate + INTERVAL 1 DAY) FROM lineitem WHERE l_returnflag = 'R'")
def browser_timeline(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("billed", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")))
    both = tl.times_of(table(spark, sf_dir, "orders"), "o_orderkey", {"ordered": "o_orderdate"}).unionByName(tl.times_of(lines, "l_orderkey", {"shipped": "l_shipdate", "billed": "billed"}))
    return both.select("id", "type", micros_of(F.col("at")).alias("at_us"))


@query("prefetch_timeline", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'C:\\' || p_brand || '\\' || p_name END AS path, p_partkey * 100 + i AS run_time FROM part, (SELECT unnest([0, 1, 2]) AS i) WHERE i < p_size % 4")
def prefetch_timeline(spark, sf_dir):
    runs = F.filter(F.array(*[F.col("p_partkey") * 100 + i for i in range(3)]), lambda x, i: i < F.col("p_size") % 4)
    files = F.array(F.lit("C:\\other.dll"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("C:\\"), "p_brand", F.lit("\\"), "p_name")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", files.alias("files"), runs.alias("runs"))
    return tl.run_times(rows, ["p_partkey"], "p_name", "files", "runs")


@query("deletion_evidence", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'")
def deletion_evidence(spark, sf_dir):
    reasons = case(F.col("l_linenumber") % 2, F.concat(F.when(F.col("l_returnflag") == "R", "FileDelete").otherwise("FileDeleteX"), F.lit("|Close")), F.when(F.col("l_returnflag") == "R", "DataExtend|FileDelete"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", reasons.alias("reasons"))
    return tl.with_reason(rows, "reasons", "FileDelete", "l_shipdate", ntz("1995-01-01 00:00:00"), ntz("1995-06-30 00:00:00")).select("l_orderkey", "l_linenumber")


@query("client_days", "SELECT o_orderkey, n AS nth, CAST(make_date(2020 + o_orderkey % 2, 1, 1) + (n - 1)::INTEGER AS VARCHAR) AS day, o_orderkey * n AS accesses FROM orders, (SELECT unnest([1, 59, 60, 366]) AS n) WHERE o_custkey % 4 <> n % 4")
def client_days(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").select("o_orderkey", (2020 + F.col("o_orderkey") % 2).cast("int").alias("year"), *[F.when(F.col("o_custkey") % 4 != n % 4, F.col("o_orderkey") * n).alias(f"Day{n}") for n in (1, 59, 60, 366)])
    return tl.numbered_days(wide, ["o_orderkey"], "year").withColumn("day", F.col("day").cast("string"))


# Annotations and files ------------------------------------------------------


@query("pivot_annotations", """SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) FILTER (WHERE o_orderstatus = 'F') AS destination, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) FILTER (WHERE o_orderstatus = 'P') AS metadata,
arg_min(o_orderpriority, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) FILTER (WHERE o_orderkey % 3 <> 0) AS url, count(*) FILTER (WHERE o_orderstatus = 'F') = 0 AS orphan FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1""")
def pivot_annotations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'P')")
    rows = rows.select("o_custkey", "o_orderstatus", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("url"))
    return art.merged_annotations(rows, "o_custkey", "o_orderstatus", "o_orderkey", "at", "F", "P", ["url"])


@query("marks_list", "SELECT l.doc_id, quality AS actor, d.doc_id IS NULL AS inactive FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id WHERE toxic = 1")
def marks_list(spark, sf_dir):
    active = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("row_id"))
    marks = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("actor"), (-F.col("doc_id")).alias("marked_at"))
    return art.marks_list(marks, active, "marked_at").select(F.col("row_id").alias("doc_id"), "actor", "inactive")


@query("entry_list", """SELECT o_orderkey AS entry_id, count(l_orderkey) AS evidence, coalesce(string_agg(DISTINCT (l_suppkey % 7)::VARCHAR, ', ' ORDER BY (l_suppkey % 7)::VARCHAR), '') AS hosts
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey % 3 <> 0) ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY 1""")
def entry_list(spark, sf_dir):
    evidence = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("entry_id"), (F.col("l_suppkey") % 7).cast("string").alias("host"))
    return art.entry_list(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("entry_id")), evidence)


@query("ads_rows", """SELECT p_partkey, p_name AS name, p_size AS size, FALSE AS is_stream FROM part UNION ALL SELECT p_partkey, p_name || ':Zone.Identifier', 26, TRUE FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, p_name || ':' || p_brand, p_size * 2, TRUE FROM part WHERE p_size % 6 = 0""")
def ads_rows(spark, sf_dir):
    stream = lambda name, size: F.struct(name.alias("name"), size.cast("long").alias("size"))
    zone, own = stream(F.lit("Zone.Identifier"), F.lit(26)), stream(F.col("p_brand"), F.col("p_size") * 2)
    streams = F.when(F.col("p_size") % 6 == 0, F.array(zone, own)).when(F.col("p_size") % 3 == 0, F.array(zone))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"), streams.alias("streams"))
    return art.stream_rows(rows, "name", "size", "streams")


@query("suppress_equal_times", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN epoch_us(o_orderdate) + 1 ELSE NULL END AS fn_us FROM orders")
def suppress_equal_times(spark, sf_dir):
    si = micros_of(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", differing(case(F.col("o_orderkey") % 3, si, si + 1, F.lit(None)), si).alias("fn_us"))


# Decoded cells --------------------------------------------------------------


@query("mru_positions", "SELECT p_partkey, p_size % 5 AS slot, 0 AS position FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, 7, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END FROM part WHERE p_partkey % 9 <> 0")
def mru_positions(spark, sf_dir):
    # No list at all; slot 7 once or twice; what stands after the terminator, or a cut piece.
    seven, end = F.when(F.col("p_partkey") % 4 == 0, "0700000007000000").otherwise("07000000"), F.when(F.col("p_partkey") % 2 == 0, "FFFFFFFF09000000").otherwise("0A00")
    raw = F.unhex(F.concat(F.lpad(F.hex((F.col("p_size") % 5).cast("long")), 2, "0"), F.lit("000000"), seven, end))
    return art.slot_positions(table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, raw).alias("raw")), ["p_partkey"], "raw")


@query("keywords_text", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Audit success' WHEN 2 THEN 'Audit success, Audit failure' WHEN 3 THEN 'none' WHEN 4 THEN '' ELSE '0x' || printf('%x', p_size) END AS keywords FROM part")
def keywords_text(spark, sf_dir):
    text = case(F.col("p_partkey") % 6, F.lit(None), F.lit(" 0x8020000000000000 "), F.lit("0X30000000000000"), F.lit("none"), F.lit(" "), F.concat(F.lit("0x"), F.lower(F.hex(F.col("p_size").cast("long")))))
    return table(spark, sf_dir, "part").select("p_partkey", tx.audit_keywords(text).alias("keywords"))


@query("app_info", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '!!a!b' WHEN 2 THEN p_name WHEN 3 THEN '!!x' END AS exe, CASE p_partkey % 5 WHEN 2 THEN p_brand WHEN 3 THEN p_brand ELSE '' END AS description,
CASE p_partkey % 5 WHEN 2 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05') END AS at_us FROM part""")
def app_info(spark, sf_dir):
    # Plain; too few parts; whole; a name with marks and a bad time; null.
    text = case(F.col("p_partkey") % 5, F.col("p_name"), F.lit("!!a!b"), F.concat(F.lit("!!"), "p_name", F.lit("!2024/01/02:03:04:05!0!"), "p_brand"), F.concat(F.lit("!!!x!bad!0!"), "p_brand"), F.lit(None))
    found = tx.app_text(text)
    return table(spark, sf_dir, "part").select("p_partkey", found["exe"].alias("exe"), found["description"].alias("description"), micros_of(found["at"]).alias("at_us"))


@query("account_split", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 1 THEN 'A\\' || c_mktsegment END AS domain, CASE WHEN c_custkey % 6 <> 5 AND c_custkey % 5 < 4 THEN c_name END AS name FROM customer WHERE c_custkey % 6 <> 5 UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 6 = 5")
def account_split(spark, sf_dir):
    # A domain; one with a backslash; none but a dash; none; and no account.
    text = case(F.col("c_custkey") % 5, F.concat("c_mktsegment", F.lit("\\"), "c_name"), F.concat(F.lit("A\\"), "c_mktsegment", F.lit("\\"), "c_name"), F.concat(F.lit("-\\"), "c_name"), F.col("c_name"), F.concat("c_mktsegment", F.lit("\\ - ")))
    domain, name = tx.account_name(F.when(F.col("c_custkey") % 6 != 5, text))
    return table(spark, sf_dir, "customer").select("c_custkey", domain.alias("domain"), name.alias("name"))
