"""Order index, zoned histograms, group pages and scopes on odd rows."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from vestige.operators import aggregates as agg
from vestige.operators import order_index, zoned
from vestige.operators import search as find
from vestige.relation import Relation


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    return [(i, rnd.choice(["b", "A", "a", None, ""]), rnd.choice([None, 1.5, 2.5, -1.0]), rnd.random() < 0.1) for i in range(700)]


@pytest.fixture(scope="module")
def index(spark, rows):
    df = spark.createDataFrame(rows, "id long, kind string, value double, hit boolean").repartition(3)
    r = Relation("t", df, None, None, "id", ("kind",), frozenset({"id", "value"}))
    return order_index.build(r, ["kind", "-value"], hit=F.col("hit"), partitions=9)


@pytest.fixture(scope="module")
def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is None, (r[1] or "").lower(), r[2] is None, -(r[2] or 0), r[0]))


def test_pages_and_places(index, ordered):
    assert index.count() == 700
    for limit, offset in ((1, 0), (50, 0), (100, 333), (1000, 0), (50, 680), (10, 700), (5, 5000)):
        got = index.page(limit, offset).collect()
        assert [(r["position"], r["id"]) for r in got] == [(offset + k, x[0]) for k, x in enumerate(ordered[offset : offset + limit])]
        assert all(r["has_more"] == (700 > offset + limit) for r in got)
    for k in (0, 17, 699):
        assert index.place(ordered[k][0]).first()["place"] == k
    assert index.place(12345).collect() == []
    for bad in ((0, 0), (1001, 0), (5, -1)):
        with pytest.raises(ValueError):
            index.page(*bad)


def test_a_deep_page_reads_few_partitions(index):
    page = index._between(600, 700)
    assert page.select(F.input_file_name()).distinct().count() == 2 < len(index.parts)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_steps(index, ordered):
    hits = [(k, x[0], n + 1) for n, (k, x) in enumerate([(k, x) for k, x in enumerate(ordered) if x[3]])]
    assert index.match_count() == len(hits)
    for start in (None, 0, 1, 350, 698, 699, 5000):
        for limit in (1, 7, 1000):
            forward = [tuple(r) for r in index.matches(limit, start).collect()]
            assert forward == [h for h in hits if start is None or h[0] > start][:limit]
            backward = [tuple(r) for r in index.matches(limit, start, backward=True).collect()]
            assert backward == [h for h in reversed(hits) if start is None or h[0] < start][:limit]


def test_an_index_of_nothing(spark, index):
    none = order_index.build(index.relation.with_df(index.relation.df.limit(0)), ["kind"])
    assert none.count() == 0 and none.page(5).collect() == [] and none.matches(5).collect() == [] and none.matches(5, backward=True).collect() == [] and none.place(1).collect() == []


def plain_histogram(times, zone, width):
    """Bucket starts by local clock of each time, counted."""
    out = {}
    for t in times:
        local = (t.replace(tzinfo=ZoneInfo("UTC"))).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
        if width == zoned.MONTH:
            key = local.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        else:
            since = datetime(1970, 1, 5) if width == zoned.WEEK else datetime(1970, 1, 1)
            key = since + (local - since) // timedelta(seconds=width) * timedelta(seconds=width)
        out[key] = out.get(key, 0) + 1
    return [(k.strftime("%Y-%m-%d %H:%M:%S"), n) for k, n in sorted(out.items())]


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "UTC"])
@pytest.mark.parametrize("most, days", [(60, 10), (40, 30), (60, 200), (30, 700)])
def test_buckets_follow_the_local_clock(spark, zone, most, days):
    rnd = random.Random(days)
    times = [datetime(2024, 3, 1) + timedelta(seconds=rnd.randrange(days * 86_400)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)] * 3, "t timestamp_ntz")
    h = zoned.histogram(Relation("t", df, None, "t"), most, zone)
    got = h.buckets.collect()
    assert h.untimed == 3 and sum(r["n"] for r in got) == 400 and h.slots <= most
    assert got[0]["bucket"] == 0 and got[-1]["bucket"] == h.slots - 1
    if h.width >= 21_600 or zone == "UTC":
        assert [(r["label"], r["n"]) for r in got] == plain_histogram(times, zone, h.width)
    for r in got:
        start = datetime(1970, 1, 1) + timedelta(microseconds=r["start_us"])
        inside = [t for t in times if start <= t and (t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S") <= r["end_label"])]
        assert len([t for t in inside if t < start + timedelta(days=32)]) >= r["n"] > 0


def test_changes_of_an_offset():
    first, last = int(datetime(2024, 1, 1).timestamp()), int(datetime(2025, 1, 1).timestamp())
    changes = zoned.offset_changes(first, last, "America/New_York")
    assert [o for _, o in changes] == [-18000, -14400, -18000]
    assert [datetime(1970, 1, 1) + timedelta(seconds=s) for s, _ in changes[1:]] == [datetime(2024, 3, 10, 7), datetime(2024, 11, 3, 6)]
    assert zoned.offset_changes(first, last, "UTC") == [(first, 0)]


def test_histograms_without_times(spark):
    df = spark.createDataFrame([(None, "x")], "t timestamp, c string")
    h = zoned.histogram(Relation("t", df, None, "t"), 10, "Asia/Tokyo")
    assert (h.buckets.collect(), h.slots, h.untimed) == ([], 0, 1)
    one = spark.createDataFrame([(datetime(2024, 1, 1, 12), "x")], "t timestamp_ntz, c string")
    h = zoned.histogram(Relation("t", one, None, "t"), 1, "Asia/Tokyo")
    assert [(r["bucket"], r["label"], r["end_label"]) for r in h.buckets.collect()] == [(0, "2024-01-01 21:00:00", "2024-01-01 21:00:00")] and h.width == 1
    for bad in (dict(most=0), dict(most=5, column="c"), dict(most=5, column="none")):
        with pytest.raises(ValueError):
            zoned.histogram(Relation("t", df, None, "t"), **bad)


def test_group_pages(spark):
    at = datetime(2024, 1, 1)
    rows = [("x" * 2500, at, "one", "malicious"), ("x" * 2500, at + timedelta(1), "two", None), ("y", None, "never", "none"), ("", at, "b", None), (None, at, "a", "suspicious")]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, t_text string, _mark string")
    r = Relation("t", df, None, "t", None, ("k",), frozenset({"t"}), {"t": "t_text"})
    got = agg.group_page(r, ["k"]).collect()
    assert [(g["key"] and len(g["key"]), g["n"], g["first_text"], g["last_text"], g["key_clipped"], g["truncated"]) for g in got] == [(2000, 2, "one", "two", True, False), (None, 2, "a", "b", False, False), (1, 1, None, None, False, False)]
    assert len(got[0]["full_key"]) == 2500
    assert [(g["key"], g["n"]) for g in agg.group_page(r, ["_mark", "k"]).collect()] == [(None, 3), ("malicious", 1), ("suspicious", 1)]
    assert [g["key"] for g in agg.group_page(r, ["_mark", "k"], {"_mark": None}, limit=2, offset=1).collect()] == ["y", None]
    first = agg.group_page(r, ["k"], limit=1).collect()
    assert len(first) == 1 and first[0]["truncated"]
    assert agg.group_page(r, ["k"], offset=10).collect() == []
    untimed = Relation("t", df, None, None, None, ("k",))
    assert {g["first_text"] for g in agg.group_page(untimed, ["k"]).collect()} == {None}
    for bad in (dict(by=[]), dict(by=["k"] * 5), dict(by=["k"], parent={"k": "x"}), dict(by=["k"], limit=0)):
        with pytest.raises(ValueError):
            agg.group_page(r, **bad)


def test_scopes(spark):
    at = datetime(2024, 1, 1)
    one = Relation("one", spark.createDataFrame([("a", at, "Evil"), ("b", at, "good"), ("c", at + timedelta(9), "evil"), (None, None, "evil")], "h string, t timestamp_ntz, v string"), "h", "t", None, ("v",))
    two = Relation("two", spark.createDataFrame([("evil",)], "v string"), None, None, None, ("v",))
    found = find.find_in_scope([one, two], "EVIL", find.Scope())
    assert sorted((r["relation"], r["host"] or "", r["n"]) for r in found.hits.collect()) == [("one", "", 1), ("one", "a", 1), ("one", "c", 1), ("two", "", 1)]
    assert sorted(map(tuple, found.relations.collect())) == [("one", True, 3), ("two", True, 1)]
    narrow = find.find_in_scope([one, two], "evil", find.Scope(("b", "c"), at, at + timedelta(1)))
    assert sorted(map(tuple, narrow.relations.collect())) == [("one", True, 0), ("two", False, 0)]
    assert [r["host"] for r in narrow.hosts_not_seen.collect()] == ["b"]
    nothing = find.find_in_scope([two], "evil", find.Scope(("b",)))
    assert nothing.hits.collect() == [] and nothing.hosts_not_seen.collect() == []
    wanted = spark.createDataFrame([("EVIL",), ("none",)], "value string")
    got = sorted((r["value"], r["relation"] or "", r["hits"], r["hosts"]) for r in find.sightings_by_relation([one, two], wanted).collect())
    assert got == [("EVIL", "", 4, 2), ("EVIL", "one", 3, 2), ("EVIL", "two", 1, 0), ("none", "", 0, 0)]
    for bad in ("", "x" * 1001):
        with pytest.raises(ValueError):
            find.find_in_scope([one], bad, find.Scope())
