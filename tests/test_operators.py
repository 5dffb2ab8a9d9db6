"""Rules of the operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from vestige.functions import text as tx
from vestige.functions import times as tm
from vestige.operators import aggregates as agg
from vestige.operators import hierarchy, lookups, network, records, windows
from vestige.operators import search as find
from vestige.operators.predicates import FilterError, Term, apply_filter, compile_filter, parse_search, pick_hosts, registry_pattern, safe_regex, search
from vestige.relation import Relation
from vestige.sources import tables as src


@pytest.fixture
def relation(spark):
    rows = [
        (1, "WS01", "2024-01-01T00:00:00Z", "4624", "Admin"),
        (2, "WS01", "not-a-time", "4625", "100%_done"),
        (3, "SRV01", "", "x", None),
        (4, "SRV01", "2024-01-02T00:00:00Z", None, ""),
    ]
    df = src.typed(spark.createDataFrame(rows, "id long, host string, time string, code string, user string"), {"time": "timestamp", "code": "bigint"})
    return Relation("events", df, "host", "time", "id", ("code", "user"), frozenset({"time", "code"}), {"time": "time__text", "code": "code__text"})


def ids(df):
    return sorted(r["id"] for r in df.collect())


LEAVES = [
    ({"col": "user", "op": "eq", "value": "ADMIN"}, [1]),
    ({"col": "user", "op": "eq", "value": "ADMIN", "case_sensitive": True}, []),
    ({"col": "user", "op": "contains", "value": "%_"}, [2]),
    ({"col": "user", "op": "not_contains", "value": "admin"}, [2, 3, 4]),
    ({"col": "user", "op": "is_empty"}, [3, 4]),
    ({"col": "time", "op": "conversion_failed"}, [2]),
    ({"col": "code", "op": "conversion_failed"}, [3]),
    ({"col": "code", "op": "gte", "value": 4625}, [2]),
    ({"col": "code", "op": "between", "value": [1, 5000]}, [1, 2]),
    ({"col": "user", "op": "in", "value": []}, []),
    ({"col": "user", "op": "regex", "value": "^adm"}, [1]),
    ({"and": []}, [1, 2, 3, 4]),
    ({"or": []}, []),
]


@pytest.mark.parametrize("doc,want", LEAVES)
def test_filters_and_their_complements(relation, doc, want):
    assert ids(apply_filter(relation, doc)) == want
    assert ids(apply_filter(relation, {"not": doc})) == [i for i in (1, 2, 3, 4) if i not in want]


def test_bad_documents(relation):
    deep = {"col": "user", "op": "is_empty"}
    for _ in range(9):
        deep = {"not": deep}
    for doc in (deep, {"col": "none", "op": "eq", "value": "x"}, {"col": "user", "op": "between", "value": [1, "b"]}, {"col": "user", "op": "like", "value": "x"}, {"or": [{"col": "user", "op": "is_empty"}] * 201}):
        with pytest.raises(FilterError):
            compile_filter(doc, relation)
    for pattern in ("(?=a)", r"(a)\1", "x" * 1001):
        with pytest.raises(FilterError):
            safe_regex(pattern, True)
    with pytest.raises(FilterError):
        pick_hosts(["A"], ["b"])
    assert pick_hosts(["A", "a"], ["a"]) == ["a"]


def test_search(relation):
    assert parse_search('one +"two words" -user:x', ["User"]) == [Term("", None, "one"), Term("+", None, "two words"), Term("-", "User", "x")]
    assert ids(relation.df.where(search("admin 4625", relation))) == [1, 2]
    assert ids(relation.df.where(search("+ws01 -admin", relation))) == [2]


def test_group_counts_add_up(relation):
    rows = agg.groups(relation, ["host"]).collect()
    assert [(r["key"], r["n"]) for r in rows] == [("SRV01", 2), ("WS01", 2)]
    assert agg.stack_totals(relation, ["user"]).first().asDict() == {"n": 4, "combinations": 3, "hosts": 2}


def test_types_keep_their_text(spark):
    df = spark.createDataFrame([("18446744073709551615", "2024"), ("18446744073709551616", "1601-01-01T00:00:00.1234567Z"), ("-1", "2024-01-01T00:00:00+02:00")], "n string, t string")
    rows = src.typed(df, {"n": "ubigint", "t": "timestamp"}).collect()
    assert [r["n"] is not None for r in rows] == [True, False, False]
    assert [r["t"] is not None for r in rows] == [False, True, False]
    assert rows[1]["t__text"].endswith("67Z")
    assert src.free_names(["_Host", "_host_1"], ["_host"]) == ["_host_2"]
    assert src.view_name("7 zip!") == "_7_zip"


def test_csv_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n1,"x ""y"""\n')
    (tmp_path / "b.csv").write_text("B,C\n2,3\n")
    df = src.scan_text(spark, [(str(tmp_path / "a.csv"), "H1", ""), (str(tmp_path / "b.csv"), "H2", "bob")], "run1")
    got = sorted(((r["_host"], r["A"], r["B"], r["C"]) for r in df.collect()))
    assert got == [("H1", "1", 'x "y"', None), ("H2", None, "2", "3")]
    digests = src.file_digests(spark, str(tmp_path)).collect()
    assert [len(r["sha256"]) for r in digests] == [64, 64]


def test_loose_file(spark):
    df = spark.createDataFrame([("1", "2024-01-01 00:00:00", "a", " "), ("2", "", "b", None)], "n string, t string, s string, e string")
    assert src.load_loose(df).columns == ["n", "t", "s", "e", "n__typed", "t__typed"]


def test_paths(spark):
    rows = [(5, None, "."), (6, 5, "a"), (7, 6, "b"), (8, 99, "lost"), (9, 10, "x"), (10, 9, "y"), *[(100 + i, 99 + i if i else 7, f"d{i}") for i in range(20)]]
    tree = spark.createDataFrame([("v", *r) for r in rows], "volume string, entry long, parent long, name string")
    got = {r["entry"]: (r["path"], r["state"]) for r in hierarchy.full_paths(tree, ["volume"], "entry", "parent", "name", F.col("entry") == 5).collect()}
    assert got[7] == (".\\a\\b", "root")
    assert got[8] == ("lost", "missing")
    assert got[9] == got[10] == (None, "invalid")
    assert got[119] == (".\\a\\b\\" + "\\".join(f"d{i}" for i in range(20)), "root")


def test_references(spark):
    candidates = spark.createDataFrame([(1, "ABC", "x.sys"), (2, "no", "EVIL.sys"), (3, "", ""), (4, None, "tool.exe")], "id long, hash string, basename string")
    drivers = spark.createDataFrame([(2, "late", ["abc"], ["evil.sys"]), (1, "first", ["abc", ""], ["evil.sys"])], "at long, id string, hashes array<string>, tags array<string>")
    tools = spark.createDataFrame([(1, "RMM", ["tool.exe", ""])], "at long, name string, basenames array<string>")
    got = sorted((r["id"], r["found"], r["confidence"]) for r in lookups.match_references(candidates, drivers, tools).collect())
    assert got == [(1, "first", "High"), (2, "first", "Medium"), (4, "RMM", "Medium")]


def test_network_ties_and_offset(spark):
    rows = [("h", "e", "u", "2024-01-02 03:00:00", 1, 2, "eth", "p"), ("h", "e", "u", "2024-01-02 03:30:00", 1, 2, "wifi", "q"), ("h", "e", "u", None, 9, 9, "x", "p")]
    usage = spark.createDataFrame(rows, "host string, exe string, user string, at string, sent long, received long, interface string, profile string").withColumn("at", F.to_timestamp_ntz("at"))
    day = network.daily(usage, -300).first()
    assert (day["day"], day["interface"], day["samples"], day["total"], day["profiles"]) == (19723, "wifi", 2, 6, 2)
    assert [r["share"] for r in network.hourly(usage.withColumn("sent", F.lit(0).cast("long"))).collect()] == [0.0]


def test_zones():
    assert windows.local_to_utc("2024-07-01 12:00:00", "Europe/Berlin") == "2024-07-01 10:00:00"
    for bad in ("2024-03-31 02:30:00", "2024-10-27 02:30:00"):
        with pytest.raises(ValueError):
            windows.local_to_utc(bad, "Europe/Berlin")


def test_boundaries_and_texts(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 00:59:00' AS a, timestamp_ntz'2024-01-01 02:01:00' AS b, 'http://u:p@[::1]:80/x' AS url").select(
        tm.hour_boundaries(F.col("a"), F.col("b")).alias("hours"), tx.host_of(F.col("url")).alias("host"), tm.filetime_text(F.lit(116444736000000001)).alias("ft"), tm.timespan_text(F.lit(-90061500000)).alias("span")
    ).first()
    assert row["hours"] == 2 and row["host"] == "[::1]" and row["ft"] == "1970-01-01T00:00:00.0000001Z" and row["span"] == "-1.01:01:01.5000000"


def test_superseding_twice_is_once(spark):
    old = spark.createDataFrame([("r", "A", 1), ("r", "B", 2)], "relation string, host string, v long")
    new = spark.createDataFrame([("r", "A", 3)], "relation string, host string, v long")
    once = records.supersede(old, new, ["relation", "host"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, records.supersede(once, new, ["relation", "host"]).collect())) == [("r", "A", 3), ("r", "B", 2)]


def test_registry_glob():
    import re

    pattern = re.compile(registry_pattern(r"ROOT\Soft*\*\Run").replace("(?iu)", "(?i)"))
    assert pattern.match(r"root\software\MS\run") and pattern.match(r"ROOT\Softx\a\Run\sub") and not pattern.match(r"ROOT\Softx\a\b\Run")


def numbers(spark, rows):
    df = spark.createDataFrame(rows, "id long, host string, value long, wide string")
    return Relation("t", df, "host", None, "id", ("wide",), frozenset({"value"}), {})


def test_pages_in_order(spark):
    rows = [(i, "h", None if i % 7 == 0 else (i * 37) % 50, "x" * 3000) for i in range(200)]
    r = numbers(spark, rows)
    for order, key in ((["value"], lambda x: (x[2] is None, x[2] or 0, x[0])), (["-value"], lambda x: (x[2] is None, -(x[2] or 0), x[0]))):
        want = [x[0] for x in sorted(rows, key=key)]
        for offset in (0, 60, 180, 500):
            got = windows.page(r, F.lit(True), order, 50, offset).collect()
            assert [x["id"] for x in got] == want[offset : offset + 50]
            assert [x["position"] for x in got] == list(range(offset, offset + len(got)))
            assert all(x["has_more"] == (offset + 50 < 200) and len(x["wide"]) == 2000 for x in got)
    assert [windows.row_offset(r, "value", i).first()["place"] for i in (0, 1, 7, 8)] == [sorted(rows, key=lambda x: (x[2] is None, x[2] or 0, x[0])).index(rows[i]) for i in (0, 1, 7, 8)]


def test_numbers_lose_no_wide_row(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("k"), F.repeat(F.col("id").cast("string"), 60).alias("wide"))
    got = {r["k"]: (r["position"], r["ordinal"], len(r["wide"])) for r in windows.numbered(df, ["k"], F.col("k") % 3 == 0).collect()}
    assert len(got) == 30_000 and [got[k][0] for k in sorted(got)] == list(range(1, 30_001))
    assert [got[k][1] for k in sorted(got) if k % 3 == 0] == list(range(1, sum(k % 3 == 0 for k in got) + 1))
    assert all(got[k][1] is None for k in got if k % 3)


def test_merged_rows_in_order(spark):
    df = spark.createDataFrame([(i, "h", f"2024-01-{i % 9 + 1:02d} 00:00:00" if i % 5 else None, "text") for i in range(40)], "id long, host string, at string, text string").withColumn("at", F.to_timestamp_ntz("at"))
    two = [Relation(n, df, "host", "at", "id", ("text",)) for n in "ab"]
    got = find.merged_rows(two, {"a": F.lit(True), "b": F.col("id") > 20}, 50).collect()
    keys = [(r["seen_at"] is None, str(r["seen_at"]), r["relation"], r["row_id"]) for r in got]
    assert keys == sorted(keys) and [r["position"] for r in got] == list(range(50))


def test_gaps_across_partitions(spark):
    rows = [("hot", i) for i in range(0, 900) if i % 100 not in (5, 6)] + [("hot", 10), ("b", 1), ("b", 9), (None, 3), (None, 5), ("c", None)]
    got = sorted(((r["s"], r["first_missing"], r["last_missing"]) for r in windows.record_gaps(spark.createDataFrame(rows, "s string, n long"), "s", "n").collect()), key=repr)
    assert got == sorted([("hot", 100 * i + 5, 100 * i + 6) for i in range(9)] + [("b", 2, 8), (None, 4, 4)], key=repr)


def test_lookup_with_a_repeated_key(spark):
    rows, lookup = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1, "z"), (1, "b"), (None, "n")], "k long, v string")
    assert sorted(((r["k"], r["v"]) for r in lookups.enrich(rows, lookup, ["k"], ["v"], "-").collect()), key=repr) == sorted([(1, "b"), (2, "-"), (None, "-")], key=repr)


def test_marks_inside_a_filter(spark, relation):
    marked = records.with_marks(relation, spark.createDataFrame([(1, "malicious"), (4, "suspicious")], "row_id long, mark string"))
    mark = lambda op, v: {"col": "_mark", "op": op, "value": v}
    assert ids(apply_filter(marked, mark("eq", "none"))) == [2, 3]
    assert ids(apply_filter(marked, {"not": {"or": [mark("in", ["malicious"]), {"col": "user", "op": "is_empty"}]}})) == [2]
    for bad in (mark("eq", "other"), mark("contains", "malicious")):
        with pytest.raises(FilterError):
            compile_filter(bad, marked)
    with pytest.raises(FilterError):
        compile_filter(mark("eq", "none"), relation)
    for pattern in ("^(a+)+$", "(x*)*", "(a|b+){2,}"):
        with pytest.raises(FilterError):
            safe_regex(pattern, True)
    assert safe_regex("(a+)b+", False) == "(a+)b+"


def test_packed_cells():
    from vestige.functions.split import parts_of

    assert parts_of(' {"a": "1", "a": 1.50, "b": {"x": [1, 2]} } ') == [("a", '"1"'), ("a", "1.50"), ("b", '{"x": [1, 2]}')]
    for text in ("{}", '{"a": }', '{"a": NaN}', '{"a": 1} x', "[1]", "one", "", "  ", "¦", "a ¦ "):
        assert parts_of(text) == [(None, text)]
    assert parts_of("User: A: b ¦ c ¦  ¦ : d") == [("User", "A: b"), (None, "c"), (None, ": d")]
    assert parts_of("a\r\n\n b\tc") == [(None, "a"), (None, " b"), (None, "c")]
    many = parts_of("\t".join(map(str, range(1500))))
    assert len(many) == 1000 and many[998] == (None, "998") and many[999] == (None, "\t".join(map(str, range(999, 1500))))
    many = parts_of("{" + ",".join(f'"k{i}":{i}' for i in range(1500)) + "}")
    assert len(many) == 1000 and many[999][1].startswith('{"k999":999,"k1000":1000')


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N

    from vestige.operators.storage import ensure_folder

    with pytest.raises(ValueError):
        ensure_folder(N(conf=N(get=lambda *_: None), sparkContext=N(master="spark://host:7077", getCheckpointDir=lambda: None)))


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text", "array(id) AS list")
    hinted = lambda d: "strategy=broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(lookups.sized(df)) and not hinted(lookups.sized(df, most=99)) and not hinted(lookups.sized(df, most_bytes=50_000))
    assert hinted(lookups.sized(df.limit(0)))


def test_spans_and_zone_texts(spark):
    from vestige.functions import times as tm

    spans = {0: "00:00:00", 1: "00:00:00.0000001", -36_000_000_001: "-01:00:00.0000001", 864_000_000_000: "1.00:00:00", 9_223_372_036_854_775_807: "10675199.02:48:05.4775807"}
    df = spark.createDataFrame([(k,) for k in spans], "t long")
    assert [r[0] for r in df.select(tm.span_text(F.col("t"))).collect()] == list(spans.values())
    assert [tuple(r) for r in df.limit(1).select(tm.duration_text(F.lit(0), F.lit(5)), tm.duration_text(F.lit(5), F.lit(3))).collect()] == [("", "-00:00:00.0000002")]
    texts = {
        "2024-01-31T10:00:00.2040000Z": ("2024-01-31 05:00:00.2040000", "-05:00"),
        "2024-07-31T10:00:00Z": ("2024-07-31 06:00:00", "-04:00"),
        "2024-07-31T10:00:00.Z": None, "2024-07-31 10:00:00Z": None, "2024-07-31T10:00:00": None, "2024-13-31T10:00:00Z": None, "2024-07-31T10:00:00.1234567890Z": None,
        "1850-01-01T12:00:00.5Z": ("1850-01-01 07:03:58.5", "-04:56:02"),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and tuple(r[0]) for r in df.select(tm.rendered(F.col("t"), "America/New_York")).collect()]
    assert got == list(texts.values())
    assert df.limit(1).select(tm.rendered(F.col("t"), "UTC")).first()[0]["offset"] == "Z"
