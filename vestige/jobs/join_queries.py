"""Lookups, references, hierarchies, runs and records over the order and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions.times import micros_of
from vestige.jobs.registry import query, table
from vestige.operators import hierarchy, lookups, network, records
from vestige.operators.search import union

# Roles: visits are orders and what they point to are customers; parts are a tree (parent = key div 2, 0 the root).


@query("history_visits", """SELECT o_orderkey, o_custkey AS target, c_name, CASE WHEN c_custkey IS NULL THEN 'dangling' ELSE '' END AS note FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON o_custkey = c_custkey
UNION ALL SELECT NULL, c_custkey, c_name, 'URL only' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def history_visits(spark, sf_dir):
    visits = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    urls = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    return lookups.outward(visits, urls, "o_custkey", "c_custkey", "URL only").select("o_orderkey", F.coalesce("o_custkey", "c_custkey").alias("target"), "c_name", "note")


@query("firefox_history", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 10) ON o_custkey = c_custkey UNION ALL SELECT NULL, c_name FROM customer WHERE c_nationkey < 10 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def firefox_history(spark, sf_dir):
    places = table(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey", "c_name")
    return lookups.outward(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), places, "o_custkey", "c_custkey", "place only").select("o_orderkey", "c_name")


@query("srum_enrich", "SELECT o_orderkey, coalesce(c_name, '') AS c_name, coalesce(n_name, '') AS n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def srum_enrich(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(users.select("o_custkey", "c_nationkey"), "o_custkey", "left")
    named = lookups.enrich(rows, users, ["o_custkey"], ["c_name"])
    return lookups.enrich(named, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), ["c_nationkey"], ["n_name"]).select("o_orderkey", "c_name", "n_name")


@query("amcache_associate", "SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Unassociated') AS p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def amcache_associate(spark, sf_dir):
    programs = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lookups.associate(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), programs, "l_partkey", "p_name").select("l_orderkey", "l_linenumber", "p_name")


@query("sum_role_join", "SELECT s_suppkey, coalesce(n_name, 'Unknown Role') AS role, 2000 + s_suppkey % 3 AS year FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey")
def sum_role_join(spark, sf_dir):
    roles = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("role"))
    clients = union([table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 3 == y).select("s_suppkey", "s_nationkey", F.lit(2000 + y).cast("long").alias("year")) for y in range(3)])
    return lookups.enrich(clients, roles, ["s_nationkey"], ["role"], "Unknown Role").select("s_suppkey", "role", "year")


@query("lol_match", """WITH d AS (SELECT p_partkey AS nth, p_name AS id, lower(p_brand) AS h, lower(p_type) AS b FROM part WHERE p_size < 4),
dh AS (SELECT h, arg_min(id, nth) AS id FROM d GROUP BY h), db AS (SELECT b, arg_min(id, nth) AS id FROM d GROUP BY b),
t AS (SELECT lower(p_type) AS b, arg_min(p_name, p_partkey) AS tool FROM part WHERE p_size = 50 GROUP BY 1)
SELECT c.p_partkey, 'driver' AS list, coalesce(dh.id, db.id) AS found, CASE WHEN dh.id IS NOT NULL THEN 'High' ELSE 'Medium' END AS confidence
FROM part c LEFT JOIN dh ON lower(c.p_brand) = dh.h LEFT JOIN db ON lower(c.p_type) = db.b WHERE dh.id IS NOT NULL OR db.id IS NOT NULL
UNION ALL SELECT c.p_partkey, 'tool', tool, 'Medium' FROM part c JOIN t ON lower(c.p_type) = t.b""")
def lol_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    drivers = part.where("p_size < 4").select(F.col("p_partkey").alias("at"), F.col("p_name").alias("id"), F.array("p_brand").alias("hashes"), F.array("p_type").alias("tags"))
    tools = part.where("p_size = 50").select(F.col("p_partkey").alias("at"), F.col("p_name").alias("name"), F.array("p_type").alias("basenames"))
    found = lookups.match_references(part.select("p_partkey", F.upper("p_brand").alias("hash"), F.col("p_type").alias("basename")), drivers, tools)
    return found.select("p_partkey", "list", "found", "confidence")


@query("download_chains", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' -> ' ORDER BY l_linenumber, l_partkey::VARCHAR) AS chain FROM lineitem GROUP BY 1")
def download_chains(spark, sf_dir):
    return lookups.joined_chain(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("url")), "l_orderkey", "l_linenumber", "url")


@query("mac_vendor", "SELECT c_custkey, coalesce(n_name, '(Unknown vendor)') AS vendor FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def mac_vendor(spark, sf_dir):
    vendors = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("vendor"))
    return lookups.enrich(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), vendors, ["c_nationkey"], ["vendor"], "(Unknown vendor)").select("c_custkey", "vendor")


@query("appid_describe", "SELECT p_partkey, coalesce(n_name, '') AS description FROM part LEFT JOIN nation ON p_size = n_nationkey")
def appid_describe(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p_size"), F.col("n_name").alias("description"))
    return lookups.enrich(table(spark, sf_dir, "part").select("p_partkey", "p_size"), known, ["p_size"], ["description"]).select("p_partkey", "description")


@query("parent_name", "SELECT c.p_partkey, p.p_name AS parent_name FROM part c LEFT JOIN part p ON c.p_partkey // 2 = p.p_partkey")
def parent_name(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    parents = part.select(F.col("p_partkey").alias("parent"), F.col("p_name").alias("parent_name"))
    return part.withColumn("parent", F.floor(F.col("p_partkey") / 2)).join(parents, "parent", "left").select("p_partkey", "parent_name")


PATHS_SQL = """WITH RECURSIVE t(p_partkey, path) AS (SELECT p_partkey, p_partkey::VARCHAR FROM part WHERE p_partkey = 1 OR p_partkey = 0
UNION ALL SELECT c.p_partkey, t.path || '\\' || c.p_partkey FROM part c JOIN t ON c.p_partkey // 2 = t.p_partkey WHERE c.p_partkey > 1)
SELECT p_partkey, path FROM t"""


@query("mft_paths", PATHS_SQL)
def mft_paths(spark, sf_dir):
    tree = table(spark, sf_dir, "part").select((F.col("p_partkey") * 0).alias("volume"), "p_partkey", F.floor(F.col("p_partkey") / 2).alias("parent"))
    return hierarchy.full_paths(tree, ["volume"], "p_partkey", "parent", "p_partkey", F.col("p_partkey") < 2).select("p_partkey", "path")


@query("mft_path_states", "WITH RECURSIVE t(k, state) AS (SELECT p_partkey, CASE WHEN p_partkey < 2 THEN 'root' WHEN p_partkey // 2 IN (7, 12) THEN 'missing' WHEN p_partkey % 10 = 9 THEN 'invalid' END FROM part WHERE (p_partkey < 2 OR p_partkey // 2 IN (7, 12) OR p_partkey % 10 = 9) AND p_partkey NOT IN (7, 12) UNION ALL SELECT c.p_partkey, t.state FROM part c JOIN t ON c.p_partkey // 2 = t.k WHERE c.p_partkey > 1 AND c.p_partkey % 10 <> 9 AND c.p_partkey NOT IN (7, 12)) SELECT k AS p_partkey, state FROM t")
def mft_path_states(spark, sf_dir):
    tree = table(spark, sf_dir, "part").where("p_partkey NOT IN (7, 12)").select((F.col("p_partkey") * 0).alias("volume"), "p_partkey", F.floor(F.col("p_partkey") / 2).alias("parent"))
    follows = (F.col("p_partkey") % 10 != 9) | F.col("parent").isin(7, 12)
    return hierarchy.full_paths(tree, ["volume"], "p_partkey", "parent", "p_partkey", F.col("p_partkey") < 2, follows).select("p_partkey", "state")


@query("usn_parent_path", PATHS_SQL.replace("SELECT p_partkey, path FROM t", "SELECT l_orderkey, l_linenumber, coalesce(path, '') AS parent_path FROM lineitem LEFT JOIN t ON l_partkey = p_partkey"))
def usn_parent_path(spark, sf_dir):
    paths = mft_paths(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), F.col("path").alias("parent_path"))
    return lookups.enrich(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), paths, ["l_partkey"], ["parent_path"]).select("l_orderkey", "l_linenumber", "parent_path")


USAGE_SQL = "WITH u AS (SELECT user_id % 7 AS host, event_type AS exe, user_id AS \"user\", ts AS seen, value::BIGINT AS sent, (value * 2)::BIGINT AS received, 'if' || (user_id + event_id) % 3 AS interface, (event_id % 5)::VARCHAR AS profile FROM events)"


def usage(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("host"), F.col("event_type").alias("exe"), F.col("user_id").alias("user"), F.col("ts").alias("at"), F.rint("value").cast("long").alias("sent"),
        F.rint(F.col("value") * 2).cast("long").alias("received"), F.concat(F.lit("if"), ((F.col("user_id") + F.col("event_id")) % 3).cast("string")).alias("interface"), (F.col("event_id") % 5).cast("string").alias("profile"),
    )


@query("daily_network", USAGE_SQL + """, c AS (SELECT host, exe, "user", (epoch_us(seen) - 18000000000) // 86400000000 AS day, interface, count(*) AS n FROM u GROUP BY ALL),
m AS (SELECT host, exe, "user", day, arg_max(interface, (n, interface)) AS interface FROM c GROUP BY ALL)
SELECT u.host, u.exe, u."user", m.day, sum(sent)::BIGINT AS sent, sum(received)::BIGINT AS received, (sum(sent) + sum(received))::BIGINT AS total, count(*) AS samples, m.interface, count(DISTINCT profile) AS profiles
FROM u JOIN m ON u.host = m.host AND u.exe = m.exe AND u."user" = m."user" AND m.day = (epoch_us(seen) - 18000000000) // 86400000000 GROUP BY u.host, u.exe, u."user", m.day, m.interface""")
def daily_network(spark, sf_dir):
    return network.daily(usage(spark, sf_dir), -300)


@query("hourly_network", USAGE_SQL + """, h AS (SELECT host, exe, "user", epoch_us(seen) // 3600000000 AS hour, sum(sent)::BIGINT AS sent, sum(received)::BIGINT AS received, count(*) AS samples FROM u GROUP BY ALL)
SELECT host, exe, "user", hour, sent, received, samples, round(CASE WHEN sum(sent) OVER w > 0 THEN sent / sum(sent) OVER w ELSE 0 END, 6) AS share, NOT (hour % 24 BETWEEN 8 AND 17) AS out_of_hours FROM h WINDOW w AS (PARTITION BY host, exe)""")
def hourly_network(spark, sf_dir):
    return network.hourly(usage(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("session_network", USAGE_SQL + " SELECT host, exe, \"user\", epoch_us(seen) // 86400000000 AS day, count(*) AS sessions, sum(sent)::BIGINT AS seconds FROM u GROUP BY ALL")
def session_network(spark, sf_dir):
    return network.sessions(usage(spark, sf_dir).withColumn("seconds", F.col("sent")))


@query("host_offset", "SELECT c_nationkey AS host, -coalesce(max(CASE WHEN c_custkey % 5 = 0 THEN c_custkey END), max(CASE WHEN c_custkey % 5 = 1 THEN c_custkey END) + coalesce(max(CASE WHEN c_custkey % 5 = 2 THEN c_custkey END), 0)) AS minutes FROM customer GROUP BY 1")
def host_offset(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 == 0, "ActiveTimeBias").when(F.col("c_custkey") % 5 == 1, "Bias").when(F.col("c_custkey") % 5 == 2, "StandardBias")
    return network.host_offset(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("host"), name.alias("name"), F.col("c_custkey").cast("string").alias("value")))


# Runs: orders in three slices are three runs of each host (customer key mod 7).
RUN = "o_orderkey % 3"


@query("latest_run_wins", """WITH s AS (SELECT o_orderkey AS source_id, o_orderstatus AS relation, o_custkey % 7 AS host, o_orderdate AS loaded_at, o_orderkey % 10 = 0 AS removed FROM orders)
SELECT source_id, relation, host, coalesce(NOT removed AND row_number() OVER (PARTITION BY relation, host, removed ORDER BY loaded_at DESC, source_id DESC) = 1, FALSE) AS active FROM s""")
def latest_run_wins(spark, sf_dir):
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("relation"), (F.col("o_custkey") % 7).alias("host"), F.col("o_orderdate").alias("loaded_at"), (F.col("o_orderkey") % 10 == 0).alias("removed"))
    return records.latest_runs(sources).select("source_id", "relation", "host", "active")


@query("supersede", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 7 < 4 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 7 NOT IN (SELECT DISTINCT o_custkey % 7 FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 7 < 4)")
def supersede(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("host", F.col("o_custkey") % 7).withColumn("relation", F.lit("orders"))
    return records.supersede(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1 AND host < 4"), ["relation", "host"]).select("o_orderkey")


@query("skip_covered_copies", "SELECT event_id FROM events WHERE event_type <> 'view' AND user_id % 7 NOT IN (SELECT o_custkey % 7 FROM orders WHERE o_custkey % 7 < 3)")
def skip_covered_copies(spark, sf_dir):
    copies = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("host", F.col("user_id") % 7)
    whole = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("host")).where("host < 3")
    return records.skip_covered(copies, whole).select("event_id")


@query("rebind_annotations", """WITH old AS (SELECT o_orderkey AS row_id, md5(o_orderstatus || o_orderpriority || o_custkey) AS row_hash, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey ORDER BY o_orderkey) AS occurrence, o_custkey % 7 AS host FROM orders WHERE o_orderkey % 2 = 0),
new AS (SELECT o_orderkey AS row_id, md5(o_orderstatus || o_orderpriority || o_custkey) AS row_hash, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey ORDER BY o_orderkey) AS occurrence, o_custkey % 7 AS host FROM orders WHERE o_orderkey % 2 = 1)
SELECT o.row_id, n.row_id AS new_id, CASE WHEN n.row_id IS NULL THEN 'left' ELSE 'moved' END AS outcome FROM old o LEFT JOIN new n ON o.row_hash = n.row_hash AND o.occurrence = n.occurrence AND o.host = n.host WHERE o.row_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def rebind_annotations(spark, sf_dir):
    from vestige.operators.windows import occurrences

    content = ["o_orderstatus", "o_orderpriority", "o_custkey"]

    def run(rest):
        rows = occurrences(table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == rest), content, "o_orderkey")
        return rows.select(F.col("o_orderkey").alias("row_id"), F.md5(F.concat("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("row_hash"), "occurrence", (F.col("o_custkey") % 7).alias("host"))

    old = run(0)
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0")
    marks = urgent.select(F.col("o_orderkey").alias("row_id"), F.lit("suspicious").alias("mark"))
    return records.rebind(marks, old, run(1)).select("row_id", "new_id", "outcome")


@query("row_marks", """WITH ev AS (SELECT l_orderkey AS entry_id, l_partkey AS row_id FROM lineitem), en AS (SELECT o_orderkey AS entry_id, o_orderstatus = 'F' AS vouched, o_orderpriority = '5-LOW' AS deleted FROM orders),
d AS (SELECT row_id, CASE WHEN bool_or(vouched) THEN 'malicious' ELSE 'agent_malicious' END AS mark, coalesce(min(CASE WHEN vouched THEN e.entry_id END), min(e.entry_id)) AS "by" FROM ev e JOIN en ON e.entry_id = en.entry_id WHERE NOT deleted GROUP BY 1)
SELECT * FROM d UNION ALL SELECT doc_id, 'suspicious', NULL FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT row_id FROM d)""")
def row_marks(spark, sf_dir):
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("row_id"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), (F.col("o_orderstatus") == "F").alias("by_analyst"), F.lit(False).alias("reviewed"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))
    stored = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id"), F.lit("suspicious").alias("mark"))
    return records.derived_marks(stored, evidence, entries)


@query("f_mark", """WITH m AS (SELECT doc_id, arg_min(CASE WHEN toxic = 1 THEN 'malicious' ELSE 'suspicious' END, quality) AS mark FROM labels WHERE toxic = 1 OR quality = 0 GROUP BY 1)
SELECT doc_id FROM documents LEFT JOIN m USING (doc_id) WHERE (coalesce(mark, 'none') <> 'malicious' AND lang = 'en') OR coalesce(mark, 'none') IN ('suspicious', 'agent_malicious')""")
def f_mark(spark, sf_dir):
    from vestige.operators.predicates import apply_filter
    from vestige.relation import Relation

    lab = table(spark, sf_dir, "labels").where("toxic = 1 OR quality = 0")
    marks = lab.groupBy(F.col("doc_id").alias("row_id")).agg(F.min_by(F.when(F.col("toxic") == 1, "malicious").otherwise("suspicious"), "quality").alias("mark"))
    docs = Relation("documents", table(spark, sf_dir, "documents").select("doc_id", "lang"), row_id="doc_id", data=("lang",))
    leaf = lambda c, op, v: {"col": c, "op": op, "value": v}
    wanted = {"or": [{"and": [leaf("_mark", "ne", "malicious"), leaf("lang", "eq", "EN")]}, leaf("_mark", "in", ["suspicious", "agent_malicious"])]}
    return apply_filter(records.with_marks(docs, marks), wanted).select("doc_id")


@query("mark_counts", "SELECT mark, relation, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN 'malicious' ELSE 'none' END AS mark, lang AS relation FROM labels JOIN documents USING (doc_id)) GROUP BY ROLLUP (mark, relation) HAVING mark IS NOT NULL")
def mark_counts(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 1, "malicious").otherwise("none").alias("mark"))
    return records.mark_counts(marks, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("relation")))


@query("tag_counts", "SELECT quality AS tag, count(*) AS n FROM labels GROUP BY 1")
def tag_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("tag")).agg(F.count("*").alias("n")).orderBy("tag")


@query("record_seen", """SELECT l_partkey AS record_id, count(DISTINCT l_orderkey) AS entries, epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us, string_agg(DISTINCT (o_custkey % 7)::VARCHAR, ', ' ORDER BY (o_custkey % 7)::VARCHAR) AS hosts, count(DISTINCT o_custkey % 7) AS n_hosts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def record_seen(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("record_id"), F.col("l_orderkey").alias("entry_id"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("at"), (F.col("o_custkey") % 7).cast("string").alias("host"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))
    seen = records.record_seen(links, entries)
    return seen.select("record_id", "entries", micros_of(F.col("first_seen")).alias("first_us"), micros_of(F.col("last_seen")).alias("last_us"), "hosts", "n_hosts")


@query("record_list", "SELECT p_partkey, CASE WHEN lower(p_name) = 'red widget' THEN 0 WHEN starts_with(lower(p_name), 'red') AND FALSE THEN 1 WHEN contains(lower(p_name), 'red widget') THEN 2 END AS rank FROM part WHERE contains(lower(p_name), 'red widget')")
def record_list(spark, sf_dir):
    return records.best_match(table(spark, sf_dir, "part"), "p_name", "Red Widget").select("p_partkey", "rank")


@query("evidence_recheck", "SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 4 = 3 THEN 'source removed' WHEN o_custkey % 4 = 2 THEN 'superseded' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM orders")
def evidence_recheck(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    attached = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("row_hash"), (F.col("o_custkey") % 4).alias("source_id"))
    now = o.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(F.col("o_orderstatus")).alias("row_hash"))
    sources = o.select((F.col("o_custkey") % 4).alias("source_id")).where("source_id < 3").distinct().withColumn("active", F.col("source_id") < 2)
    return records.evidence_state(attached, now, sources)


@query("relation_counts", "SELECT o_orderstatus AS relation, count(*) AS n, count(DISTINCT o_custkey % 7) AS hosts FROM orders GROUP BY 1")
def relation_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("relation")).agg(F.count("*").alias("n"), F.countDistinct(F.col("o_custkey") % 7).alias("hosts"))


@query("annotated_ids", "SELECT doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT item_id FROM benchmark")
def annotated_ids(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return union([lab.where("toxic = 1").select(F.col("doc_id").alias("id")), lab.where("quality = 0").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))]).distinct()


@query("host_zones", "SELECT DISTINCT c_nationkey AS host, n_name AS zone FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def host_zones(spark, sf_dir):
    zones = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("host"), F.col("n_name").alias("zone"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("host")).distinct().join(lookups.sized(zones), "host", "left")
