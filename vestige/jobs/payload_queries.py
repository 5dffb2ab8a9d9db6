"""Event XML and rules, packed cells, written results."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions import text as tx
from vestige.functions import times as tm
from vestige.functions.split import split_value
from vestige.jobs.registry import query, table
from vestige.operators import payload as pay
from vestige.operators.storage import fresh_path
from vestige.sources import sinks
from vestige.sources import tables as src


def event_xml(spark, sf_dir):
    """Events as XML: without data, with user data (named, or in elements of its own), with unnamed, repeated and empty data, attributes, marks that must be escaped, ids that are no number."""
    who, kind = F.col("user_id").cast("string"), F.col("user_id") % 11
    code = F.when(F.col("user_id") % 50 == 49, "none").otherwise((F.col("user_id") % 5).cast("string"))
    head = F.concat(
        F.lit("<?xml version='1.0'?><Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name=\"P"), F.col("user_id") % 3, F.lit('"/><EventID Qualifiers="7"> '), code,
        F.lit(" </EventID><Task>"), F.col("user_id") % 4, F.lit('</Task><TimeCreated SystemTime="2024-01-01T00:00:00Z">shown</TimeCreated><Channel>'), "event_type", F.lit("</Channel><Computer>H"), F.col("user_id") % 7, F.lit("</Computer></System>"),
    )
    data = F.concat(F.lit('<Data Name="user">'), who, F.lit('</Data><Data Name="empty"/><Data>'), "props", F.lit('</Data><Data Name="a&amp;b">x &lt; y</Data><Data Name="user">second</Data>'))
    own = F.concat(F.lit('<LogFileCleared xmlns="http://own"><SubjectUserName>bob'), who, F.lit('</SubjectUserName><Sid Kind="a">0xab</Sid><Sid Kind="b">0xcd</Sid></LogFileCleared>'))
    body = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("<UserData>"), data, F.lit("</UserData>"))).when(kind == 2, F.concat(F.lit("<UserData>"), own, F.lit("</UserData>")))
    body = body.otherwise(F.concat(F.lit("<EventData>"), data, F.lit("<Binary>00ff</Binary></EventData>")))
    return table(spark, sf_dir, "events").select("event_id", F.concat(head, body, F.lit("</Event>")).alias("xml"))


PAYLOAD_SQL = """SELECT event_id, CASE WHEN user_id % 11 = 0 THEN '' WHEN user_id % 11 = 2 THEN '{"UserData":{"Data":[]}}' ELSE '{"' || CASE WHEN user_id % 11 = 1 THEN 'UserData' ELSE 'EventData' END || '":{"Data":[{"@Name":"user","#text":"' || user_id || '"},{"@Name":"empty"},{"#text":"' || replace(props, '"', '\\"') || '"},{"@Name":"a&b","#text":"x < y"},{"@Name":"user","#text":"second"}]}}' END AS payload,
CASE WHEN user_id % 11 < 3 THEN '' ELSE 'user: ' || user_id || '|empty: |' || props || '|a&b: x < y|user: second' END AS first FROM events"""


@query("event_payload", PAYLOAD_SQL)
def event_payload(spark, sf_dir):
    return pay.parsed(event_xml(spark, sf_dir), "xml").select("event_id", pay.payload("xml").alias("payload"), F.array_join(pay.first_data(), "|").alias("first"))


#: A user's rules: the events they are for, their place, and how a column is filled. Two fill ``PayloadData1`` of one event.
RULES = [
    ("error", "0", "Failure", 1, "PayloadData1", "code %user% at %where% (%none%)", [("user", '/Event/EventData/Data[@Name="user"]'), ("where", "/Event/System/Computer"), ("none", "/Event/EventData/Data[@Name='user']")]),
    ("error", "0", "Failure", 2, "PayloadData2", "", [("mark", '/Event/EventData/Data[@Name="a&b"]'), ("other", "/Event/System/Task")]),
    ("error", "0", "Failure", 3, "PayloadData1", "%b%%a%", [("b", "/Event/EventData/Binary"), ("a", "/Event/EventData/Data")]),
    ("error", "0", "Failure", 4, "MapDescription", "Failure %task%", [("task", "/Event/System/Task")]),
    ("signup", "2", "New account", 1, "UserName", "%user%", [("user", '/Event/UserData/Data[@Name="user"]')]),
    ("signup", "2", "New account", 2, "RemoteHost", "%x%/%time%", [("x", "/Event/UserData/LogFileCleared/SubjectUserName"), ("time", "/Event/System/TimeCreated")]),
    ("signup", "2", "New account", 3, "ExecutableInfo", "%second%", [("second", '/Event/UserData/LogFileCleared/Sid[@Kind="b"]')]),
    ("signup", "2", "New account", 4, "Unknown", "%x%", [("x", "/Other/System/Task")]),
    ("view", "4", "Seen", 1, "PayloadData3", "", [("deep", "/Event/EventData/Data/Deeper")]),
    ("click", "0", "Without number", 1, "PayloadData6", "%user%", [("user", '/Event/EventData/Data[@Name="user"]')]),
]

# What the rules' paths give for an event, and the event's channel and id.
VALUES_SQL = """e AS (SELECT event_id, event_type AS channel, CASE WHEN user_id % 50 = 49 THEN 0 ELSE user_id % 5 END AS code, user_id % 4 AS task, user_id % 7 AS host,
  CASE WHEN user_id % 11 > 2 THEN user_id::VARCHAR ELSE '' END AS data_user, CASE WHEN user_id % 11 > 2 THEN 'x < y' ELSE '' END AS data_mark, CASE WHEN user_id % 11 > 2 THEN '00ff' ELSE '' END AS data_binary,
  CASE WHEN user_id % 11 = 1 THEN user_id::VARCHAR ELSE '' END AS own_user, CASE WHEN user_id % 11 = 2 THEN 'bob' || user_id ELSE '' END AS cleared, CASE WHEN user_id % 11 = 2 THEN '0xCD' ELSE '' END AS sid, props, user_id % 11 > 2 AS has_data FROM events),
filled AS (
  SELECT event_id, 'Failure' AS description, 1 AS nth, 'PayloadData1' AS property, 'code ' || data_user || ' at H' || host || ' ()' AS payload FROM e WHERE channel = 'error' AND code = 0
  UNION ALL SELECT event_id, 'Failure', 2, 'PayloadData2', data_mark FROM e WHERE channel = 'error' AND code = 0
  UNION ALL SELECT event_id, 'Failure', 3, 'PayloadData1', data_binary || data_user FROM e WHERE channel = 'error' AND code = 0
  UNION ALL SELECT event_id, 'Failure', 4, 'MapDescription', 'Failure ' || task FROM e WHERE channel = 'error' AND code = 0
  UNION ALL SELECT event_id, 'New account', 1, 'UserName', own_user FROM e WHERE channel = 'signup' AND code = 2
  UNION ALL SELECT event_id, 'New account', 2, 'RemoteHost', cleared || '/shown' FROM e WHERE channel = 'signup' AND code = 2
  UNION ALL SELECT event_id, 'New account', 3, 'ExecutableInfo', sid FROM e WHERE channel = 'signup' AND code = 2
  UNION ALL SELECT event_id, 'New account', 4, 'Unknown', '' FROM e WHERE channel = 'signup' AND code = 2
  UNION ALL SELECT event_id, 'Seen', 1, 'PayloadData3', '' FROM e WHERE channel = 'view' AND code = 4
  UNION ALL SELECT event_id, 'Without number', 1, 'PayloadData6', data_user FROM e WHERE channel = 'click' AND code = 0)"""


def rules_table(spark):
    return spark.createDataFrame(RULES, pay.RULES)


@query("event_maps", f"""WITH {VALUES_SQL} SELECT description, property, count(*) AS n, count(*) FILTER (WHERE payload <> '') AS filled, count(DISTINCT payload) AS texts FROM filled GROUP BY 1, 2""")
def event_maps(spark, sf_dir):
    """Of each rule's column how many events it is for, how many it fills, and with how many texts."""
    rows = pay.mapped(event_xml(spark, sf_dir), rules_table(spark)).where("property <> ''")
    return rows.groupBy("description", "property").agg(F.count("*").alias("n"), F.count_if(F.col("payload") != "").alias("filled"), F.count_distinct("payload").alias("texts"))


@query("event_map_join", f"""WITH {VALUES_SQL} SELECT event_id, description, property, payload FROM filled
UNION ALL SELECT event_id, '', '', '' FROM e WHERE event_id NOT IN (SELECT event_id FROM filled)""")
def event_map_join(spark, sf_dir):
    return pay.mapped(event_xml(spark, sf_dir), rules_table(spark)).select("event_id", "description", "property", "payload")


@query("event_map_columns", f"""WITH {VALUES_SQL},
latest AS (SELECT event_id, property, arg_max(payload, nth) AS payload FROM filled GROUP BY 1, 2), about AS (SELECT event_id, max(description) AS description FROM filled GROUP BY 1),
wide AS (SELECT event_id, max(payload) FILTER (WHERE property = 'MapDescription') AS said, max(payload) FILTER (WHERE property = 'UserName') AS u, max(payload) FILTER (WHERE property = 'RemoteHost') AS r, max(payload) FILTER (WHERE property = 'ExecutableInfo') AS x,
  max(payload) FILTER (WHERE property = 'PayloadData1') AS p1, max(payload) FILTER (WHERE property = 'PayloadData2') AS p2, max(payload) FILTER (WHERE property = 'PayloadData3') AS p3, max(payload) FILTER (WHERE property = 'PayloadData6') AS p6 FROM latest GROUP BY 1)
SELECT e.event_id, coalesce(w.said, a.description, '') AS MapDescription, coalesce(u, '') AS UserName, coalesce(r, '') AS RemoteHost, coalesce(x, '') AS ExecutableInfo,
  CASE WHEN a.event_id IS NOT NULL THEN coalesce(p1, '') WHEN has_data THEN 'user: ' || data_user ELSE '' END AS PayloadData1, CASE WHEN a.event_id IS NOT NULL THEN coalesce(p2, '') WHEN has_data THEN 'empty: ' ELSE '' END AS PayloadData2,
  CASE WHEN a.event_id IS NOT NULL THEN coalesce(p3, '') WHEN has_data THEN props ELSE '' END AS PayloadData3, CASE WHEN a.event_id IS NULL AND has_data THEN 'a&b: x < y' ELSE '' END AS PayloadData4,
  CASE WHEN a.event_id IS NULL AND has_data THEN 'user: second' ELSE '' END AS PayloadData5, coalesce(p6, '') AS PayloadData6
FROM e LEFT JOIN about a USING (event_id) LEFT JOIN wide w USING (event_id)""")
def event_map_columns(spark, sf_dir):
    return pay.mapped_columns(event_xml(spark, sf_dir), rules_table(spark)).drop("xml")


@query("split_value", """WITH p AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN [struct_pack(key := 'k', value := regexp_extract(props, '(\\d+)', 1)), struct_pack(key := 'k', value := '"' || event_type || '"')]
WHEN 1 THEN [struct_pack(key := 'User', value := user_id::VARCHAR), struct_pack(key := NULL, value := event_type)] WHEN 2 THEN [struct_pack(key := NULL, value := event_type), struct_pack(key := NULL, value := user_id::VARCHAR)]
WHEN 3 THEN [struct_pack(key := NULL, value := event_type)] ELSE [struct_pack(key := NULL, value := '')] END AS parts FROM events)
SELECT event_id, i - 1 AS nth, parts[i].key AS key, parts[i].value AS value FROM p, unnest(range(1, len(parts) + 1)) t(i)""")
def split_values(spark, sf_dir):
    who, kind, digits = F.col("user_id").cast("string"), F.col("event_type"), F.regexp_extract("props", r"(\d+)", 1)
    packed = (
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit(' {"k": '), digits, F.lit(', "k":"'), kind, F.lit('" } ')))
        .when(F.col("user_id") % 5 == 1, F.concat(F.lit("User: "), who, F.lit(" ¦  ¦ "), kind))
        .when(F.col("user_id") % 5 == 2, F.concat(kind, F.lit("\r\n\t"), who))
        .when(F.col("user_id") % 5 == 3, kind)
        .otherwise("")
    )
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(split_value(packed)).alias("nth", "part")).select("event_id", F.col("nth").cast("long").alias("nth"), "part.key", "part.value")


ODD_SQL = "'  \"' || event_type || '\",' || chr(10) || props || ' '"


def written(spark, sf_dir):
    odd = F.concat(F.lit('  "'), "event_type", F.lit('",\n'), "props", F.lit(" "))
    df = table(spark, sf_dir, "events").select("event_id", "ts", odd.alias("odd"), F.when(F.col("user_id") % 3 > 0, F.col("event_type")).alias("kind"))
    path = fresh_path(spark, "export")
    sinks.export_csv(df, ["event_id", "ts", "odd", "kind"], ["ts", "event_id"], path, {"ts": "Asia/Kolkata"})
    return path


@query("export_csv", f"SELECT event_id::VARCHAR AS event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') || ' +05:30' AS ts, {ODD_SQL} AS odd, CASE WHEN user_id % 3 > 0 THEN event_type ELSE '' END AS kind FROM events")
def export_csv(spark, sf_dir):
    return sinks.read_csv(spark, written(spark, sf_dir), ["event_id", "ts", "odd", "kind"]).withColumn("kind", F.coalesce("kind", F.lit("")))


@query("write_json", "SELECT event_id, event_type, CASE WHEN user_id % 3 > 0 THEN props END AS props FROM events")
def write_json(spark, sf_dir):
    path = fresh_path(spark, "json")
    sinks.write_json(table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 3 > 0, F.col("props")).alias("props")), path)
    return spark.read.schema("event_id long, event_type string, props string").json(path)


@query("sha256_manifest", "SELECT (o_custkey % 7)::VARCHAR AS slice, length(string_agg(o_orderkey::VARCHAR || chr(10), '')) AS length, sha256(string_agg(o_orderkey::VARCHAR || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM orders GROUP BY 1")
def sha256_manifest(spark, sf_dir):
    path = fresh_path(spark, "slices")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("slice")).repartition("slice").sortWithinPartitions("slice", "o_orderkey")
    rows.select(F.col("o_orderkey").cast("string").alias("value"), "slice").write.partitionBy("slice").text(path)
    files = src.file_digests(spark, path).where(F.col("path").endswith(".txt"))
    return files.select(F.regexp_extract("path", r"slice=(\d+)", 1).alias("slice"), "length", "sha256")


@query("scan_raw", "SELECT p_partkey::VARCHAR AS k, p_name AS name, 'run1' AS _run_id, 'H1' AS _host, 'bob' AS _identity FROM part UNION ALL SELECT s_suppkey::VARCHAR, NULL, 'run1', 'H2', '' FROM supplier")
def scan_raw(spark, sf_dir):
    one, two = fresh_path(spark, "scan"), fresh_path(spark, "scan")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")).write.csv(one, header=True)
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).write.csv(two, header=True)
    return src.scan_text(spark, [(one, "H1", "bob"), (two, "H2", "")], "run1").select("k", "name", "_run_id", "_host", "_identity")


def host_files(spark, sf_dir):
    """Events as CSV files by host, those of half of the hosts without ``props``; (path, host, identity) of each file."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("Kind"), "props", (F.col("user_id") % 40).alias("host"))
    wide, narrow = fresh_path(spark, "hosts"), fresh_path(spark, "hosts")
    rows.where("host < 20").repartition("host").write.partitionBy("host").csv(wide, header=True, quoteAll=True, escape='"')
    rows.where("host >= 20").drop("props").repartition("host").write.partitionBy("host").csv(narrow, header=True, quoteAll=True)
    files = src.list_files(spark, wide, ".csv").unionByName(src.list_files(spark, narrow, ".csv"))
    host = F.regexp_extract("path", r"host=(\d+)", 1)
    return files.select("path", F.concat(F.lit("H"), host).alias("host"), F.when(host.cast("int") % 3 > 0, F.concat(F.lit("user:u"), host)).alias("identity"))


@query("scan_hosts", """SELECT event_id::VARCHAR AS id, event_type AS "Kind", CASE WHEN user_id % 40 < 20 THEN props END AS props, 'run1' AS run, 'H' || user_id % 40 AS host,
CASE WHEN user_id % 40 % 3 > 0 THEN 'user:u' || user_id % 40 END AS identity, true AS named FROM events""")
def scan_hosts(spark, sf_dir):
    """Files of forty hosts with two headers: two scans."""
    scanned = src.scan_text(spark, host_files(spark, sf_dir), "run1")
    named = F.contains("_output_file", F.concat(F.lit("host="), F.regexp_extract("_host", r"\d+", 0), F.lit("/")))
    return scanned.select("id", "Kind", "props", F.col("_run_id").alias("run"), F.col("_host").alias("host"), F.col("_identity").alias("identity"), named.alias("named"))


@query("merge_user_files", """SELECT event_id::VARCHAR AS id, event_type AS "Kind", props, CASE WHEN user_id % 40 % 3 > 0 THEN 'user:u' || user_id % 40 ELSE 'system' END AS "TriageUser" FROM events WHERE user_id % 40 < 20""")
def merge_user_files(spark, sf_dir):
    """Each user's own file of one dataset, read as one table with the user."""
    wide = [(r["identity"] or "", r["path"]) for r in host_files(spark, sf_dir).where(F.substring("host", 2, 9).cast("int") < 20).collect()]
    return src.merge_user_files(spark, wide)


@query("name_allocate", 'SELECT event_id AS "_host_2", user_id AS "_7_zip" FROM events')
def name_allocate(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias(src.free_names(["_Host", "_host_1"], ["_host"])[0]), F.col("user_id").alias(src.view_name("7 zip!")))


@query("local_to_utc", """SELECT event_id, epoch_us(CASE WHEN wall < TIMESTAMP '2024-03-31 02:00:00' THEN wall - INTERVAL 1 HOUR WHEN wall >= TIMESTAMP '2024-03-31 03:00:00' AND wall < TIMESTAMP '2024-10-27 02:00:00' THEN wall - INTERVAL 2 HOUR WHEN wall >= TIMESTAMP '2024-10-27 03:00:00' THEN wall - INTERVAL 1 HOUR END) AS us
FROM (SELECT event_id, ts + to_days(CASE WHEN user_id % 2 = 0 THEN 75 ELSE 285 END) AS wall FROM events)""")
def local_to_utc(spark, sf_dir):
    wall = F.when(F.col("user_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 75 DAYS")).otherwise(F.col("ts") + F.expr("INTERVAL 285 DAYS"))
    return table(spark, sf_dir, "events").select("event_id", tm.micros_of(tm.wall_to_utc(wall, "Europe/Berlin")).alias("us"))


@query("extension", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'txt' ELSE '' END AS ext FROM part")
def extension(spark, sf_dir):
    name = F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(".v1.TXT"))).when(F.col("p_size") % 4 == 1, F.regexp_replace("p_name", r"\.", "")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(tx.extension(name)).alias("ext"))


#: Named SQL of an artefact over its tables: CASE, left join, decoded time.
MAPS = {
    "visits": "SELECT v.o_orderkey AS id, CASE v.o_orderstatus WHEN 'P' THEN 'typed' WHEN 'F' THEN 'link' ELSE 'other' END AS kind, u.c_name AS url, unix_micros(CAST(v.o_orderdate AS TIMESTAMP)) AS at_us FROM {visits} v LEFT JOIN {urls} u ON v.o_custkey = u.c_custkey",
}


@query("sql_map", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'typed' WHEN 'F' THEN 'link' ELSE 'other' END AS kind, c_name AS url, epoch_us(o_orderdate) AS at_us FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def sql_map(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = sinks.run_map(spark, MAPS["visits"], {"visits": orders, "urls": table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")})
    return out.drop("at_us").join(orders.select(F.col("o_orderkey").alias("id"), tm.micros_of(F.col("o_orderdate")).alias("at_us")), "id")
