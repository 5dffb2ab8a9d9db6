"""Rules of the reports and timelines on hand-made rows: nulls, repeats, ties, empty tables."""

from pyspark.sql import functions as F

from vestige.functions import text as tx
from vestige.operators import artifacts as art
from vestige.operators import timelines as tl
from vestige.operators.artifacts import Step
from vestige.operators.timelines import Leg


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_follow_keeps_rows_without_and_multiplies_repeated_keys(spark):
    terms = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "term int, url int")
    urls = spark.createDataFrame([(10, 5), (10, 6)], "id int, visit int")
    visits = spark.createDataFrame([(5, "a")], "v int, title string")
    out = art.follow(terms, Step(urls, {"url": "id"}, "no url"), Step(visits, {"visit": "v"}, "no visit"))
    assert rows(out.select("term", "title", "note")) == [(1, "a", ""), (1, None, "no visit"), (2, None, "no url"), (3, None, "no url")]
    assert art.follow(terms, Step(urls, {"url": "id"}, required=True)).count() == 2
    assert art.follow(terms.limit(0), Step(urls, {"url": "id"})).count() == 0


def test_annotations_take_the_last_destination_and_the_first_text(spark):
    data = [(1, "d", "old", 1, None), (1, "d", "new", 2, ""), (1, "m", "meta", 3, "t"), (2, "m", "x", 1, None), (None, "d", "y", 1, "z")]
    df = spark.createDataFrame(data, "place int, kind string, content string, at int, title string")
    out = art.merged_annotations(df, "place", "kind", "content", "at", "d", "m", ["title"])
    assert rows(out.select("place", "destination", "metadata", "title", "orphan")) == [(1, "new", "meta", "t", False), (2, None, "x", None, True)]


def test_decodes_of_odd_cells(spark):
    df = spark.createDataFrame([("!!a.exe!2024/01/02:03:04:05!7!d",), ("!!a!!b!2024/13/40:00:00:00!7!",), ("a.exe",), ("!!x",), ("",), (None,)], "t string")
    found = tx.app_text(F.col("t"))
    got = [(r[0], r[1], str(r[2])) for r in df.select(found["exe"], found["description"], found["at"]).collect()]
    assert got == [("a.exe", "d", "2024-01-02 03:04:05"), ("a!!b", "", "None"), ("a.exe", "", "None"), ("!!x", "", "None"), ("", "", "None"), (None, "", "None")]
    masks = spark.createDataFrame([("0x8010000000000000",), ("0x0",), ("0x00000000000000000001",), ("",), (None,)], "t string")
    assert [r[0] for r in masks.select(tx.audit_keywords(F.col("t"))).collect()] == ["Audit failure", "0x0", "0x00000000000000000001", "", None]
    kinds = spark.createDataFrame([("LogonType 4294967295",), ("LogonType 4294967296",), ("LogonType ",), ("LogonType 3\n",), (None,)], "t string")
    assert [r[0] for r in kinds.select(tx.logon_type(F.col("t"))).collect()] == [4294967295, None, None, None, None]
    lists = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"\xff" * 4)), (3, bytearray(b"\x01\0\0\0\x02\x01\0\0\xff")), (4, None)], "id int, raw binary")
    assert rows(art.slot_positions(lists, ["id"], "raw")) == [(3, 1, 0), (3, 258, 1)]


def test_timelines_of_nothing_and_of_ties(spark):
    a = spark.createDataFrame([(1, "X", "2024-01-01 00:00:00"), (2, "x", None)], "id int, n string, t string").withColumn("t", F.col("t").try_cast("timestamp_ntz"))
    b = spark.createDataFrame([(3, "x"), (4, None)], "id int, n string")
    legs = [Leg("a", a, "id", "t", "n"), Leg("b", b, "id", None, "n")]
    assert [(r["leg"], r["id"]) for r in tl.everywhere(legs, "X").collect()] == [("a", 1), ("a", 2), ("b", 3)]
    low, high = (F.to_timestamp_ntz(F.lit(t)) for t in ("2024-01-01 00:00:00", "2024-01-01 00:00:00"))
    assert [r["id"] for r in tl.cross_timeline(legs[:1], low, high).collect()] == [1]
    assert tl.times_of(a, "id", {"t": "t"}).count() == 1
    files = spark.createDataFrame([("A.EXE", ["c:\\B.EXE", "c:\\A.EXE"], [1, 2]), ("Z.EXE", [], [3]), ("N.EXE", None, None)], "exe string, files array<string>, runs array<int>")
    assert rows(tl.run_times(files, ["exe"], "exe", "files", "runs").select("path", "run_time")) == [("Z.EXE", 3), ("c:\\A.EXE", 1), ("c:\\A.EXE", 2)]


def test_account_logons_add_up_ids_of_several_rows_and_group_nothing_else(spark):
    summary = spark.createDataFrame([("Dom", "User", "success", 3, "h", 2), (None, "user", "success", 3, "h", 4), ("DOM", "USER", "success", 3, "h", 8), ("x", None, "failed", 3, "h", 16), ("other", "User", "failed", None, "h", 32)], "domain string, account string, outcome string, logon_type long, host string, n long")
    accounts = spark.createDataFrame([(1, "uSER", None), (2, "user", "dOM"), (3, "user", "dom"), (3, "USER", None), (4, None, "dom"), (None, "user", "other"), (None, "user", "other"), (5, "user", "nowhere")], "account_id long, name string, domain string")
    out = art.account_logons(summary, accounts)
    want = [(1, "failed", None, "h", 32), (1, "success", 3, "h", 14), (2, "success", 3, "h", 10), (3, "failed", None, "h", 32), (3, "success", 3, "h", 24), (None, "failed", None, "h", 64)]
    assert rows(out) == sorted(want, key=repr)
    assert rows(art.account_logons(summary, accounts.limit(0))) == rows(art.account_logons(summary.limit(0), accounts)) == []
    # Accounts of one id each pass the join and no aggregate.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Aggregate") == 1
