"""Indicators, identifiers and accounts in cells, and what rows offer for the record."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions import indicators as ind
from vestige.jobs.registry import query, table
from vestige.operators import artifacts as art
from vestige.operators import offers, recognised
from vestige.operators.storage import fresh_path
from vestige.relation import Relation


def chosen(by: str, *texts: str) -> str:
    """SQL: one of the texts, by a number."""
    return f"CASE {by} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


# Addresses as they are written, and in their one form (NULL: none).
ADDRESSES = [
    ("'2001:DB8:0:0:0:0:' || printf('%x', page_id + 1) || ':01'", "'2001:db8::' || printf('%x', page_id + 1) || ':1'"),
    ("'::FFFF:10.0.' || page_id // 256 % 256 || '.' || page_id % 256", "'::ffff:10.0.' || page_id // 256 % 256 || '.' || page_id % 256"),
    ("'::10.0.0.' || page_id % 256", "'::a00:' || printf('%x', page_id % 256)"),
    ("'1:0:0:2:0:0:0:' || printf('%04X', page_id + 1)", "'1:0:0:2::' || printf('%x', page_id + 1)"),
    ("'10.0.0.' || page_id % 400", "CASE WHEN page_id % 400 <= 255 THEN '10.0.0.' || page_id % 400 END"),
    ("'1::2::' || page_id", "NULL"),
    ("'1:2:3:4:5:6:' || printf('%x', page_id + 1) || '::'", "'1:2:3:4:5:6:' || printf('%x', page_id + 1) || ':0'"),
    ("'1:2:3:4:5:6:7:8:' || page_id", "NULL"),
    ("'fe80::1%eth' || page_id", "NULL"),
    ("'1:2:3:4:5:6:10.0.0.' || page_id % 300", "CASE WHEN page_id % 300 <= 255 THEN '1:2:3:4:5:6:a00:' || printf('%x', page_id % 300) END"),
    ("'::'", "'::'"),
    ("' 10.0.0.1'", "NULL"),
    ("'010.0.0.1'", "NULL"),
]
# Other kinds: which, the text, and what is kept of it.
VALUES = [
    ("domain", "'WWW-' || page_id || '.Example.ORG'", "'www-' || page_id || '.example.org'"),
    ("hostname", "'bad_host' || page_id", "NULL"),
    ("url", "'HTTPS://u:p@host-' || page_id || ':8080/x?y#z'", "'HTTPS://u:p@host-' || page_id || ':8080/x?y#z'"),
    ("url", "'ftp://[2001:db8::' || printf('%x', page_id) || ']:' || page_id * 100 || '/'", "CASE WHEN page_id * 100 <= 65535 THEN 'ftp://[2001:db8::' || printf('%x', page_id) || ']:' || page_id * 100 || '/' END"),
    ("url", "'gopher://host/' || page_id", "NULL"),
    ("url", "'http://host/with blank' || page_id", "NULL"),
    ("email", "'A.b+' || page_id || '@Mail.Example'", "'A.b+' || page_id || '@Mail.Example'"),
    ("email", "'a@b@c' || page_id", "NULL"),
    ("md5", "upper(md5(url))", "md5(url)"),
    ("sha1", "md5(url) || page_id", "CASE WHEN length(page_id::VARCHAR) = 8 THEN md5(url) || page_id END"),
    ("sha256", "upper(sha2(url, 256))", "sha256(url)"),
    ("file_name", "'dir' || chr(92) || 'file' || page_id", "NULL"),
    ("file_name", "'File ' || page_id || '.EXE'", "'File ' || page_id || '.EXE'"),
    ("file_path", "'C:' || chr(92) || 'x' || chr(9) || page_id", "'C:' || chr(92) || 'x' || chr(9) || page_id"),
    ("registry_key", "'HKLM' || chr(10) || page_id", "NULL"),
    ("service", "repeat('s', 4090 + page_id % 12)", "CASE WHEN page_id % 12 <= 6 THEN repeat('s', 4090 + page_id % 12) END"),
    ("scheduled_task", "'   '", "NULL"),
    ("other", "'anything ' || page_id", "'anything ' || page_id"),
]


def _spark(sql: str) -> str:
    return sql.replace(" // ", " div ")


@query("ioc_validate", f"SELECT page_id, {chosen('page_id', *[want for _, want in ADDRESSES])} AS ip, {chosen('page_id', *[want for _, _, want in VALUES])} AS value FROM pages")
def ioc_validate(spark, sf_dir):
    """Each kind of indicator in its one form, or null."""
    pages = table(spark, sf_dir, "pages")
    address = F.expr(_spark(chosen("page_id", *[text for text, _ in ADDRESSES])))
    value = F.coalesce(*[F.when(F.col("page_id") % len(VALUES) == i, ind.indicator(kind, F.expr(_spark(text)))) for i, (kind, text, _) in enumerate(VALUES)])
    return pages.select("page_id", ind.indicator("ip", address).alias("ip"), value.alias("value"))


GUESSES = [
    ("'https://host/' || page_id", "'url'"),
    ("upper(md5(url))", "'md5'"),
    ("md5(url) || '01234567'", "'sha1'"),
    ("sha2(url, 256)", "'sha256'"),
    ("'10.0.0.' || page_id % 400", "CASE WHEN page_id % 400 <= 255 THEN 'ip' ELSE 'domain' END"),
    ("'2001:db8::' || printf('%x', page_id % 65536)", "'ip'"),
    ("'a.b@c.org'", "'email'"),
    ("'www.x-1.ORG'", "'domain'"),
    ("'no kind'", "NULL"),
    ("NULL", "NULL"),
    ("''", "NULL"),
]


@query("ioc_guess", f"SELECT page_id, {chosen('page_id', *[want for _, want in GUESSES])} AS kind FROM pages")
def ioc_guess(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ind.guessed_kind(F.expr(_spark(chosen("page_id", *[text for text, _ in GUESSES])))).alias("kind"))


SIDS = [
    ("'s-1-05-21-00' || p_partkey", "'S-1-5-21-' || p_partkey"),
    ("'S-1-5'", "NULL"),
    ("'S-1-5-' || 4294967290 + p_partkey % 10", "CASE WHEN 4294967290 + p_partkey % 10 < 4294967296 THEN 'S-1-5-' || 4294967290 + p_partkey % 10 END"),
    ("'S-1-281474976710656-1'", "NULL"),
    ("'S-1-5' || repeat('-1', 14 + cast(p_partkey % 3 AS int))", "CASE WHEN p_partkey % 3 < 2 THEN 'S-1-5' || repeat('-1', 14 + cast(p_partkey % 3 AS int)) END"),
    ("'S-1-x-' || p_partkey", "NULL"),
    ("'S-2-5-' || p_partkey", "NULL"),
]


@query("sid_validate", f"SELECT p_partkey, {chosen('p_partkey', *[want for _, want in SIDS]).replace('4294967290 + p_partkey % 10 END', '(4294967290 + p_partkey % 10) END')} AS sid FROM part")
def sid_validate(spark, sf_dir):
    text = chosen("p_partkey", *[text for text, _ in SIDS]).replace("4294967290 + p_partkey % 10", "(4294967290 + p_partkey % 10)")
    return table(spark, sf_dir, "part").select("p_partkey", ind.sid(F.expr(text)).alias("sid"))


#: Which columns of which relations offer what.
TAKERS = [
    offers.Taker("log_events", "UserName", "account"),
    offers.Taker("log_events", "PayloadData1", "logon_target"),
    offers.Taker("log_events", "RemoteHost", "address"),
    offers.Taker("cache_*_files", "SHA1", "sha1"),
    offers.Taker("usage_*", "UserName", "account", "Sid"),
    offers.Taker("usage_*", "Url", "url"),
    offers.Taker("usage_*", "None", "url"),
]

USERS = ["'ACME' || chr(92) || 'user' || user_id", "'user' || user_id", "'-' || chr(92) || 'user' || user_id", "'-'", "'ACME' || chr(92)", "NULL"]
TARGETS = ["'Target: acme' || chr(92) || 'USER' || user_id", "'Target: other' || user_id", "'target: x'", "NULL"]
HOSTS = ["'WS (a) (::FFFF:10.0.0.' || user_id % 300 || ')'", "'10.0.0.' || user_id % 300", "'- (-)'", "'WS01'", "NULL"]


@query("candidates", """WITH cells AS (
  SELECT event_id, user_id, user_id % 6 AS u, user_id % 4 AS t, user_id % 5 AS h, user_id % 300 AS last FROM events),
users AS (
  SELECT 'log_events' AS relation, event_id AS row_id, 1 AS place, 'account' AS kind, NULL AS ioc_type, 'user' || user_id AS value, CASE WHEN u = 0 THEN 'ACME' END AS domain, NULL AS sid, 'UserName' AS column FROM cells WHERE u < 3
  UNION ALL SELECT 'log_events', event_id, 2, 'account', NULL, CASE t WHEN 0 THEN 'USER' ELSE 'other' END || user_id, CASE WHEN t = 0 THEN 'acme' END, NULL, 'PayloadData1' FROM cells WHERE t < 2 AND NOT (t = 0 AND u = 0)
  UNION ALL SELECT 'log_events', event_id, 3, 'ioc', 'ip', CASE h WHEN 0 THEN '::ffff:' ELSE '' END || '10.0.0.' || last, NULL, NULL, 'RemoteHost' FROM cells WHERE h < 2 AND last <= 255
  UNION ALL SELECT 'log_events', event_id, 4, 'ioc', 'file_path', 'logs/' || user_id, NULL, NULL, 'File' FROM cells WHERE user_id % 3 > 0
  UNION ALL SELECT 'cache_of_files', p_partkey, 1, 'ioc', 'sha1', md5(p_name) || '01234567', NULL, NULL, 'SHA1' FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'usage_apps', o_orderkey, 1, 'account', NULL, 'user' || o_custkey, 'ACME', CASE WHEN o_orderkey % 3 = 0 THEN 'S-1-5-21-' || o_custkey END, 'UserName' FROM orders
  UNION ALL SELECT 'usage_apps', o_orderkey, 2, 'ioc', 'url', 'http://host/' || o_custkey, NULL, NULL, 'Url' FROM orders WHERE o_orderkey % 2 = 0),
accounts AS (SELECT lower(name) AS name, lower(domain) AS domain, min(id) AS id FROM (SELECT c_custkey AS id, 'User' || c_custkey % 100 AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Acme' WHEN c_custkey % 3 = 1 THEN '' END AS domain FROM customer) x GROUP BY 1, 2),
own AS (SELECT name, nullif(domain, '') AS domain, min(id) AS id FROM accounts GROUP BY 1, 2)
SELECT relation, row_id, row_number() OVER (PARTITION BY relation, row_id ORDER BY place) - 1 AS nth, kind, ioc_type, value, u.domain, sid, "column",
  CASE kind WHEN 'account' THEN coalesce(a.id, b.id) ELSE i.id END AS existing_id
FROM users u LEFT JOIN own a ON a.name = lower(value) AND a.domain IS NOT DISTINCT FROM lower(u.domain) LEFT JOIN own b ON b.name = lower(value) AND b.domain IS NULL
LEFT JOIN (SELECT min(s_suppkey) AS id, '10.0.0.' || s_suppkey % 50 AS ip FROM supplier GROUP BY 2) i ON ioc_type = 'ip' AND ip = value""")
def candidates(spark, sf_dir):
    """Offers of three relations by one table of takers, with the records there are."""
    events = table(spark, sf_dir, "events").select("event_id", *[F.expr(chosen("user_id", *texts)).alias(c) for c, texts in (("UserName", USERS), ("PayloadData1", TARGETS), ("RemoteHost", HOSTS))], F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("logs/"), "user_id")).alias("File"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.upper(F.md5("p_name")), F.lit("01234567"))).otherwise(F.md5("p_name")).alias("SHA1"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ACME\\user"), "o_custkey").alias("UserName"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("s-1-5-21-"), "o_custkey")).otherwise("none").alias("Sid"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("http://host/"), "o_custkey")).otherwise("nothing at all").alias("Url"))
    relations = [(Relation("log_events", events, None, None, "event_id"), "File"), (Relation("cache_of_files", parts, None, None, "p_partkey"), None), (Relation("usage_apps", orders, None, None, "o_orderkey"), None)]
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("User"), F.col("c_custkey") % 100).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "Acme").when(F.col("c_custkey") % 3 == 1, "").alias("domain"))
    iocs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("ip").alias("type"), F.concat(F.lit("10.0.0."), F.col("s_suppkey") % 50).alias("value"))
    return offers.candidates(relations, TAKERS, accounts, iocs)


# Entries: orders with lines as evidence, linked with customers as hosts, suppliers as accounts and parts as indicators.
ENTRY_SQL = """links AS (
  SELECT o_orderkey AS entry_id, 0 AS ord, 'host' AS kind, c_custkey AS id, c_name AS label, o_orderdate AS linked_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0
  UNION ALL SELECT l_orderkey, 1, 'account', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ACME' || chr(92) ELSE '' END || s_name, l_shipdate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1
  UNION ALL SELECT l_orderkey, 2, 'ioc', p_partkey, 'file_name ' || p_name, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 4),
evidence AS (SELECT l_orderkey AS entry_id, l_partkey AS row_id FROM lineitem WHERE l_orderkey % 3 <> 0),
listed AS (SELECT entry_id, string_agg(kind || ':' || id || ':' || label, '|' ORDER BY ord, linked_at, id) AS links FROM links GROUP BY 1),
hosts AS (SELECT entry_id, string_agg(DISTINCT label, ', ' ORDER BY label) AS hosts FROM links WHERE kind = 'host' GROUP BY 1),
counted AS (SELECT entry_id, count(*) AS evidence FROM evidence GROUP BY 1),
entries AS (SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS time, o_orderstatus AS status, o_orderpriority AS tactic, 'Order ' || o_orderkey AS title, o_custkey FROM orders WHERE o_orderkey % 11 > 0),
shown AS (SELECT entry_id, time, status, tactic, title, o_custkey, coalesce(evidence, 0) AS evidence, coalesce(hosts, '') AS hosts, coalesce(links, '') AS links FROM entries LEFT JOIN listed USING (entry_id) LEFT JOIN hosts USING (entry_id) LEFT JOIN counted USING (entry_id))"""


def entry_tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    time = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate"))
    entries = orders.select(F.col("o_orderkey").alias("entry_id"), time.alias("time"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tactic"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.lit(None).cast("string").alias("description"), (F.col("o_orderkey") % 11 == 0).alias("deleted"))
    lines = table(spark, sf_dir, "lineitem")
    evidence = lines.where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("row_id"))
    links = {
        "host": orders.select(F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("record_id"), F.col("o_orderdate").alias("linked_at")),
        "account": lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("entry_id"), F.col("l_suppkey").alias("record_id"), F.col("l_shipdate").alias("linked_at")),
        "ioc": lines.where("l_linenumber < 4").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("record_id"), F.col("l_shipdate").alias("linked_at")),
    }
    records = {
        "host": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("deleted")),
        "account": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "ACME").alias("domain"), F.col("s_name").alias("name"), F.lit(False).alias("deleted")),
        "ioc": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("file_name").alias("type"), F.col("p_name").alias("value"), F.lit(None).cast("boolean").alias("deleted")),
    }
    return entries, evidence, art.link_rows(links, records)


def shown_entries(df):
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["kind"], x["id"].cast("string"), x["label"])), "|")
    return df.select("entry_id", "evidence", "hosts", links.alias("links"))


@query("entry_links", f"WITH {ENTRY_SQL} SELECT entry_id, evidence, hosts, links FROM shown")
def entry_links(spark, sf_dir):
    """Every live entry with its links of three kinds as one list."""
    entries, evidence, links = entry_tables(spark, sf_dir)
    return shown_entries(art.entry_list(art.pick_entries(entries, art.EntryQuery(), evidence, links), evidence, links))


@query("entry_page", f"""WITH {ENTRY_SQL},
a AS (SELECT *, row_number() OVER (ORDER BY time NULLS LAST, entry_id) - 1 AS position, count(*) OVER () AS total FROM shown WHERE status IN ('F', 'P') AND tactic = '1-URGENT' AND contains(lower(title), 'r 1')),
b AS (SELECT *, row_number() OVER (ORDER BY time NULLS LAST, entry_id) - 1 AS position, count(*) OVER () AS total FROM shown WHERE list_contains(string_split(hosts, ', '), 'Customer#000000007')),
c AS (SELECT *, row_number() OVER (ORDER BY time NULLS LAST, entry_id) - 1 AS position, count(*) OVER () AS total FROM shown WHERE entry_id IN (SELECT entry_id FROM evidence WHERE row_id = 42))
SELECT 'a' AS page, entry_id, evidence, hosts, links, position, total > 15 AS truncated FROM a WHERE position BETWEEN 5 AND 14
UNION ALL SELECT 'b', entry_id, evidence, hosts, links, position, total > 100 FROM b WHERE position < 100 UNION ALL SELECT 'c', entry_id, evidence, hosts, links, position, total > 100 FROM c WHERE position < 100""")
def entry_page(spark, sf_dir):
    """Pages of entries by status, tactic and text; by a linked host; by a row of their evidence."""
    entries, evidence, links = entry_tables(spark, sf_dir)
    asked = [("a", art.EntryQuery(("F", "P"), tactic="1-URGENT", text="R 1"), 10, 5), ("b", art.EntryQuery(host="cUSTOMER#000000007"), 100, 0), ("c", art.EntryQuery(row=42), 100, 0)]
    pages = []
    for name, q, limit, offset in asked:
        page = art.entry_page(entries, q, evidence, links, limit, offset)
        placed = page.select("entry_id", "position", "truncated")
        pages.append(shown_entries(page).join(placed, "entry_id").select(F.lit(name).alias("page"), "entry_id", "evidence", "hosts", "links", "position", "truncated"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def known_tables(spark, sf_dir) -> list[tuple[str, str, str]]:
    """Files with the header of each known kind but one, filled from parts, and one with another header."""
    parts = table(spark, sf_dir, "part")
    path = F.concat(F.lit("C:\\Dir, \"x\"\\Ü/"), "p_name", F.lit(".EXE"))
    filled = {
        "amcache_file_entries": {"FullPath": path, "SHA1": F.when(F.col("p_size") % 2 == 0, F.upper(F.sha1("p_name"))), "FileKeyLastWriteTimestamp": F.col("p_size")},
        "amcache_driver_binaries": {"DriverName": F.col("p_brand"), "DriverId": F.sha1("p_brand"), "DriverLastWriteTime": F.col("p_size")},
        "appcompat_cache": {"Path": path, "LastModifiedTimeUTC": F.col("p_size")},
        "mft": {"FileName": F.col("p_name"), "Created0x10": F.col("p_size")},
        "recycle_bin": {"FileName": F.when(F.col("p_size") % 3 > 0, path), "DeletedOn": F.col("p_size")},
    }
    files = []
    for i, (kind, cells) in enumerate(filled.items()):
        out = fresh_path(spark, kind)
        rows = parts.where(F.col("p_partkey") % 5 == i)
        columns = recognised.HEADERS[kind].split(",")
        rows.select(*[cells.get(c, F.lit("")).cast("string").alias(c) for c in columns]).write.csv(out, header=True, escape='"')
        files.append((out, f"H{i}", ""))
    other = fresh_path(spark, "other")
    parts.select(*[F.col("p_name").alias(c) for c in reversed(recognised.HEADERS["recycle_bin"].split(","))]).write.csv(other, header=True)
    return [*files, (other, "H9", "")]


@query("lol_candidates", """WITH p AS (SELECT *, 'C:' || chr(92) || 'Dir, "x"' || chr(92) || 'Ü/' || p_name || '.EXE' AS path, lower(p_name) || '.exe' AS base FROM part)
SELECT 'amcache_file_entries' AS kind, path AS evidence_path, base AS basename, CASE WHEN p_size % 2 = 0 THEN sha1(p_name) END AS sha1, p_size::VARCHAR AS evidence_timestamp, 'H0' AS host FROM p WHERE p_partkey % 5 = 0
UNION ALL SELECT 'amcache_driver_binaries', p_brand, lower(p_brand), sha1(p_brand), p_size::VARCHAR, 'H1' FROM p WHERE p_partkey % 5 = 1
UNION ALL SELECT 'appcompat_cache', path, base, NULL, p_size::VARCHAR, 'H2' FROM p WHERE p_partkey % 5 = 2
UNION ALL SELECT 'mft', p_name, lower(p_name), NULL, p_size::VARCHAR, 'H3' FROM p WHERE p_partkey % 5 = 3
UNION ALL SELECT 'recycle_bin', CASE WHEN p_size % 3 > 0 THEN path ELSE '' END, CASE WHEN p_size % 3 > 0 THEN base ELSE '' END, NULL, p_size::VARCHAR, 'H4' FROM p WHERE p_partkey % 5 = 4""")
def lol_candidates(spark, sf_dir):
    """Files known by their header give candidates of one shape; another header gives none."""
    found = recognised.candidates_of_files(spark, known_tables(spark, sf_dir))
    return found.rows.drop("source_file")
