"""Scalars, reshaping and sources over the text, part and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestige.functions import text as tx
from vestige.functions import times as tm
from vestige.jobs.registry import query, table
from vestige.operators import predicates as pred
from vestige.operators.search import summary_line
from vestige.operators.storage import fresh_path
from vestige.sources import tables as src


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("filetime_to_ts", "SELECT p_partkey, CASE WHEN p_partkey <> 0 THEN p_partkey * 1000003 - 11644473600000000 END AS us FROM part")
def filetime_to_ts(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tm.filetime_micros(F.col("p_partkey") * 10_000_037 - F.col("p_partkey") * 7).alias("us"))


@query("webkit_to_ts", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size * 1000000 - 11644473600000000 END AS us FROM part")
def webkit_to_ts(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tm.webkit_micros(F.when(F.col("p_size") > 10, F.col("p_size").cast("long") * 1_000_000).otherwise(0)).alias("us"))


@query("prtime_to_ts", "SELECT p_partkey, nullif(p_size % 5, 0)::BIGINT AS us FROM part")
def prtime_to_ts(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tm.prtime_micros(F.col("p_size") % 5).alias("us"))


@query("unix_to_ts", "SELECT p_partkey, CASE WHEN p_partkey::HUGEINT * 10000000 <= 253402300799 THEN p_partkey * 10000000000000 END AS us FROM part")
def unix_to_ts(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tm.unix_micros(F.col("p_partkey") * 10_000_000).alias("us"))


@query("unix_ms_to_ts", "SELECT p_partkey, nullif(p_partkey, 0) * 1000 AS us FROM part")
def unix_ms_to_ts(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tm.unix_ms_micros(F.col("p_partkey")).alias("us"))


@query("other_epochs", "SELECT p_partkey, p_partkey * 1000000 + 978307200000000 AS cocoa, p_partkey + 978307200000000 AS cocoa_ns, p_partkey - 62135596800000000 AS dotnet, (p_partkey - 25569) * 86400000000 AS ole FROM part")
def other_epochs(spark, sf_dir):
    k = F.col("p_partkey")
    return part(spark, sf_dir).select("p_partkey", tm.cocoa_micros(k).alias("cocoa"), tm.cocoa_ns_micros(k * 1000).alias("cocoa_ns"), tm.dotnet_micros(k * 10).alias("dotnet"), tm.ole_micros(k).alias("ole"))


# Every other time half a year on, so that both of the zone's offsets are met; fractions of no to nine digits.
ZONED_SQL = """SELECT event_id, CASE WHEN user_id % 7 = 6 THEN NULL ELSE strftime(ts + to_days(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 180 END) + to_hours(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END), '%Y-%m-%d %H:%M:%S') || CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.2040000' ELSE '.000000001' END END AS local,
CASE WHEN user_id % 7 = 6 THEN NULL WHEN user_id % 2 = 0 THEN '+01:00' ELSE '+02:00' END AS "offset" FROM events"""


@query("render_in_zone", ZONED_SQL)
def render_in_zone(spark, sf_dir):
    shifted = F.when(F.col("user_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 180 DAYS"))
    fraction = F.element_at(F.array(F.lit(""), F.lit(".5"), F.lit(".2040000"), F.lit(".000000001")), (F.col("user_id") % 4 + 1).cast("int"))
    text = F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.when(F.col("user_id") % 7 == 6, "").otherwise("Z"))
    return table(spark, sf_dir, "events").select("event_id", tm.rendered(text, "Europe/Berlin").alias("r")).select("event_id", "r.local", "r.offset")


@query("utc_offset_shift", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS day, hour(ts - INTERVAL 5 HOUR) AS hour FROM events")
def utc_offset_shift(spark, sf_dir):
    local = F.col("ts") - F.expr("INTERVAL 5 HOUR")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd").alias("day"), F.hour(local).cast("long").alias("hour"))


@query("timespan_text", """WITH s AS (SELECT p_partkey, p_partkey * 1234567 AS t, p_size % 5 = 0 AS unset, p_size % 2 = 0 AS less FROM part)
SELECT p_partkey, CASE WHEN unset THEN '' ELSE CASE WHEN less AND t > 0 THEN '-' ELSE '' END || CASE WHEN t >= 864000000000 THEN (t // 864000000000) || '.' ELSE '' END || printf('%02d:%02d:%02d', t // 36000000000 % 24, t // 600000000 % 60, t // 10000000 % 60)
|| CASE WHEN t % 10000000 > 0 THEN '.' || printf('%07d', t % 10000000) ELSE '' END END AS span FROM s""")
def timespan_text(spark, sf_dir):
    """Between two file times, forward and back, to the seventh digit; none where one was never set."""
    start = F.lit(130_000_000_000_000_000)
    other = start + F.when(F.col("p_size") % 2 == 0, -1).otherwise(1) * F.col("p_partkey") * 1_234_567
    return part(spark, sf_dir).select("p_partkey", tm.duration_text(start, F.when(F.col("p_size") % 5 == 0, 0).otherwise(other)).alias("span"))


@query("business_hours", "SELECT event_id, NOT (hour(ts) >= 22 OR hour(ts) < 6) AS outside FROM events")
def business_hours(spark, sf_dir):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").select("event_id", (~tm.in_hours(minute, 22 * 60, 6 * 60)).alias("outside"))


# Attribute bits.
ATTRIBUTES = [(1, "ReadOnly"), (2, "Hidden"), (4, "System"), (16, "Directory"), (32, "Archive")]


@query("flags_text", "SELECT p_partkey, concat_ws('|', CASE WHEN p_size & 1 <> 0 THEN 'ReadOnly' END, CASE WHEN p_size & 2 <> 0 THEN 'Hidden' END, CASE WHEN p_size & 4 <> 0 THEN 'System' END, CASE WHEN p_size & 16 <> 0 THEN 'Directory' END, CASE WHEN p_size & 32 <> 0 THEN 'Archive' END) AS flags FROM part")
def flags_text(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tx.flag_names(F.col("p_size"), ATTRIBUTES).alias("flags"))


@query("code_name", "SELECT p_partkey, CASE p_size WHEN 2 THEN 'Interactive' WHEN 3 THEN 'Network' WHEN 10 THEN 'Remote' ELSE 'Unknown (' || p_size || ')' END AS kind FROM part")
def code_name(spark, sf_dir):
    miss = F.concat(F.lit("Unknown ("), F.col("p_size").cast("string"), F.lit(")"))
    return part(spark, sf_dir).select("p_partkey", tx.code_name(F.col("p_size"), {2: "Interactive", 3: "Network", 10: "Remote"}, miss).alias("kind"))


@query("interface_type", "SELECT p_partkey, CASE p_size WHEN 6 THEN 'Ethernet' WHEN 23 THEN 'PPP' WHEN 24 THEN 'Loopback' ELSE p_size::VARCHAR END AS interface FROM part")
def interface_type(spark, sf_dir):
    luid = F.shiftleft(F.col("p_size").cast("long"), 48) + F.col("p_partkey")
    return part(spark, sf_dir).select("p_partkey", tx.code_name(F.shiftrightunsigned(luid, 48), {6: "Ethernet", 23: "PPP", 24: "Loopback"}).alias("interface"))


@query("sid_type", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'LocalSystem' WHEN p_size % 4 = 1 AND p_partkey = 500 THEN 'Administrator' WHEN p_size % 4 = 1 THEN 'User' WHEN p_size % 4 = 2 THEN 'Service' ELSE 'Other' END AS class FROM part")
def sid_type(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    sid = F.when(F.col("p_size") % 4 == 0, "S-1-5-18").when(F.col("p_size") % 4 == 1, F.concat(F.lit("S-1-5-21-7-8-9-"), F.when(F.col("p_partkey") == 501, "502").otherwise(k))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("S-1-5-80-"), k)).otherwise(F.lit("S-1-1-0"))
    return part(spark, sf_dir).select("p_partkey", tx.sid_class(sid).alias("class"))


@query("guid_text", "SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS guid FROM (SELECT p_partkey, md5(p_name) AS h FROM part)")
def guid_text(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tx.guid_text(F.unhex(F.md5("p_name"))).alias("guid"))


@query("guid_text_mixed", "SELECT p_partkey, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] AS guid FROM (SELECT p_partkey, md5(p_name) AS h FROM part)")
def guid_text_mixed(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tx.guid_text_mixed(F.unhex(F.md5("p_name"))).alias("guid"))


@query("basename", "SELECT page_id, lower(regexp_extract(url, '[^\\\\/]*$', 0)) AS name FROM pages")
def basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.basename(F.col("url")).alias("name"))


@query("host_of", "SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\\d*$', '')) AS host FROM pages")
def host_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.host_of(F.col("url")).alias("host"))


@query("file_path_join", "SELECT p_partkey, p_brand || '\\' || p_name AS path, regexp_extract(p_brand, '[^.]*$', 0) AS rest FROM part")
def file_path_join(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tx.join_path(F.col("p_brand"), F.col("p_name")).alias("path"), F.regexp_extract("p_brand", "[^.]*$", 0).alias("rest"))


@query("normalize_scalar", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '0x' || upper(printf('%x', p_partkey)) ELSE p_name END AS value FROM part")
def normalize_scalar(spark, sf_dir):
    value = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex("p_partkey")))).otherwise(F.col("p_name"))
    return part(spark, sf_dir).select("p_partkey", tx.normalised_scalar(value).alias("value"))


@query("attack_id_validate", "SELECT p_partkey, p_partkey >= 1000 AND p_partkey <= 9999 AS ok FROM part")
def attack_id_validate(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", tx.is_technique(F.concat(F.lit("T"), F.col("p_partkey").cast("string"))).alias("ok"))


@query("row_hash", "SELECT o_orderkey, sha256('o_orderstatus=' || o_orderstatus || ';o_orderpriority=' || o_orderpriority) AS digest FROM orders")
def row_hash(spark, sf_dir):
    pairs = [F.concat(F.lit(f"{c}="), F.col(c)) for c in ("o_orderstatus", "o_orderpriority")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws(";", *pairs), 256).alias("digest"))


@query("row_hash_repeats", "SELECT count(*) AS rows, count(DISTINCT struct_pack(a := text, b := lang)) AS contents FROM documents")
def row_hash_repeats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.countDistinct(tx.row_hash(["text", "lang"])).alias("contents"))


@query("derive_user", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS owner FROM customer")
def derive_user(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 4 == 0, "Public").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.user_of_path(F.concat(F.lit("C:\\Users\\"), name, F.lit("\\NTUSER.DAT"))).alias("owner"))


@query("summary_line", "SELECT p_partkey, p_name || ' · ' || p_brand || ' · ' || p_type || ' · ' || p_size AS summary FROM part")
def summary(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", summary_line(["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).alias("summary"))


@query("registry_glob", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_brand), '^brand#1.*$')")
def registry_glob(spark, sf_dir):
    path = F.concat(F.lit("ROOT\\"), "p_brand", F.lit("\\"), "p_type")
    return part(spark, sf_dir).where(path.rlike(pred.registry_pattern("root\\brand#1*"))).select("p_partkey")


@query("case_decode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS status FROM orders")
def case_decode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.code_name(F.col("o_orderstatus"), {"P": "pending", "F": "finished"}).alias("status"))


@query("typed_view", "SELECT c_custkey, c_name AS name__text, NULL::BIGINT AS name_number, c_custkey::VARCHAR AS key__text, c_custkey AS key_number FROM customer")
def typed_view(spark, sf_dir):
    text = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("key"))
    out = src.typed(text, {"name": "bigint", "key": "bigint"})
    return out.select("c_custkey", "name__text", F.col("name").alias("name_number"), "key__text", F.col("key").alias("key_number"))


@query("typed_if_z", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN epoch_us(date_trunc('second', ts)) END AS us FROM events")
def typed_if_z(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("user_id") % 2 == 0, "Z").otherwise("+02:00"))
    return table(spark, sf_dir, "events").select("event_id", tm.micros_of(src.typed_if_utc(text)).alias("us"))


@query("load_loose_file", "SELECT o_orderkey AS key_typed, epoch_us(o_orderdate) AS date_us, o_orderstatus AS status FROM orders")
def load_loose_file(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("o_orderstatus").alias("status"))
    loose = src.load_loose(text)
    return loose.select(F.col("key__typed").alias("key_typed"), tm.micros_of(F.col("date__typed")).alias("date_us"), "status")


@query("merge_per_user", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'alice' ELSE 'system' END AS \"TriageUser\" FROM orders")
def merge_per_user(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return src.merge_per_user([("", o.where("o_orderkey % 2 = 1")), ("alice", o.where("o_orderkey % 2 = 0"))])


@query("append_by_name", "SELECT o_orderkey AS k, o_orderstatus AS status, NULL AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def append_by_name(spark, sf_dir):
    return src.append_by_name([table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))])


@query("export_per_channel", "SELECT trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9-]', '_', 'g'), '_') AS file, o_orderkey, o_orderpriority FROM orders")
def export_per_channel(spark, sf_dir):
    path = fresh_path(spark, "channels")
    src.export_per_channel(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", path)
    back = spark.read.schema("o_orderkey string, o_orderpriority string, channel_file string").csv(path, header=True)
    return back.select(F.col("channel_file").alias("file"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority")


@query("merged_vs_slices", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND o_custkey % 2 = 0)")
def merged_vs_slices(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("included_in_view", (F.col("o_orderkey") % 4 == 0) | ((F.col("o_orderkey") % 4 == 1) & (F.col("o_custkey") % 2 == 0)))
    return o.where("included_in_view").select("o_orderkey")


@query("file_listing", "SELECT p_partkey, p_brand || '\\' || p_name AS path FROM part WHERE p_size % 3 <> 0")
def file_listing(spark, sf_dir):
    return part(spark, sf_dir).where("p_size % 3 <> 0").select("p_partkey", tx.join_path(F.col("p_brand"), F.col("p_name")).alias("path"))


# File times in ticks of 100 ns: created and modified of the standard information from the order's and the line's dates.
TICKS_SQL = """SELECT l_orderkey, l_linenumber, epoch_us(o_orderdate) * 10 + l_linenumber % 2 AS si_created, epoch_us(l_shipdate) * 10 + l_suppkey % 3 AS si_modified,
epoch_us(o_orderdate) * 10 + (l_linenumber % 2) * (l_partkey % 2) AS fn_created, epoch_us(l_shipdate) * 10 + l_suppkey % 3 AS fn_modified FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("timestomp_flags", f"SELECT l_orderkey, l_linenumber, fn_created > si_created AS timestomped, si_created % 10000000 = 0 AND si_modified % 10000000 = 0 AS usec_zeros, si_created = fn_created AND si_modified = fn_modified AS copied FROM ({TICKS_SQL})")
def timestomp_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey")
    joined = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    created, modified = tm.micros_of(F.col("o_orderdate")) * 10, tm.micros_of(F.col("l_shipdate")) * 10 + F.col("l_suppkey") % 3
    ticks = joined.select("l_orderkey", "l_linenumber", (created + F.col("l_linenumber") % 2).alias("si_created"), modified.alias("si_modified"), (created + F.col("l_linenumber") % 2 * (F.col("l_partkey") % 2)).alias("fn_created"), modified.alias("fn_modified"))
    flags = tm.timestomp_flags(["si_created", "si_modified"], ["fn_created", "fn_modified"])
    return ticks.select("l_orderkey", "l_linenumber", *[c.alias(name) for name, c in flags.items()])


@query("query_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 1000")
def query_sql(spark, sf_dir):
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1 ORDER BY 1", orders=table(spark, sf_dir, "orders")).limit(1000)


@query("dataset_inventory", "SELECT source AS tool, lang AS id, count(*) AS files FROM documents GROUP BY 1, 2")
def dataset_inventory(spark, sf_dir):
    """Tools with their datasets as a run's manifests list them: for each host a manifest, whose datasets hold that host's files."""
    hosts = table(spark, sf_dir, "documents").select(F.col("source").alias("tool"), F.col("lang").alias("id"), (F.col("doc_id") % 16).alias("host"), F.col("doc_id").cast("string").alias("file"))
    per = hosts.groupBy("tool", "id", F.col("host"), F.xxhash64("file").bitwiseAND(F.lit(1023)).alias("part")).agg(F.collect_list("file").alias("files"))
    datasets = per.groupBy("tool", "host", "part").agg(F.collect_list(F.struct("id", F.col("id").alias("view"), "files", F.create_map(F.lit("t"), F.lit("bigint")).alias("types"))).alias("datasets"))
    return src.inventory(datasets).groupBy("tool", "id").agg(F.sum("files").alias("files"))
