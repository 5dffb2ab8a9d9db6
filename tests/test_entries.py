"""Entries with their links, and tables known by their header."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vestige.operators import artifacts as art
from vestige.operators import recognised as rec


@pytest.fixture(scope="module")
def tables(spark):
    at = datetime(2024, 1, 1)
    entries = spark.createDataFrame(
        [(1, at, "open", "t1", "First one", None, False), (2, None, "open", "t2", "x", "The FIRST", False), (3, at, "done", "t1", "c", "", False), (4, at, "open", "t1", "first", "", True)],
        "entry_id long, time timestamp_ntz, status string, tactic string, title string, description string, deleted boolean",
    )
    evidence = spark.createDataFrame([(1, 10), (1, 11), (3, 10), (9, 10)], "entry_id long, row_id long")
    made = {
        "host": ([(1, 5, at), (1, 6, at), (2, 7, None), (3, 5, at)], [(5, "ws01", False), (6, "ab", None), (7, "gone", True)]),
        "account": ([(1, 1, at), (1, 2, datetime(2023, 1, 1))], [(1, "ACME", "bob", False), (2, None, "al", False)]),
        "ioc": ([(3, 1, at), (3, 1, at)], [(1, "ip", "1.2.3.4", False)]),
    }
    shapes = {"host": "id long, name string, deleted boolean", "account": "id long, domain string, name string, deleted boolean", "ioc": "id long, type string, value string, deleted boolean"}
    links = {k: spark.createDataFrame(v[0], "entry_id long, record_id long, linked_at timestamp") for k, v in made.items()}
    records = {k: spark.createDataFrame(v[1], shapes[k]) for k, v in made.items()}
    return entries, evidence, art.link_rows(links, records)


def test_links_of_three_kinds(tables):
    entries, evidence, links = tables
    rows = {r["entry_id"]: r for r in art.entry_list(entries, evidence, links).collect()}
    assert [tuple(x) for x in rows[1]["links"]] == [("host", 5, "ws01"), ("host", 6, "ab"), ("account", 2, "al"), ("account", 1, "ACME\\bob")]
    assert (rows[1]["hosts"], rows[1]["evidence"]) == ("ab, ws01", 2)
    assert (rows[2]["hosts"], rows[2]["evidence"], rows[2]["links"]) == ("", 0, [])
    assert [x["kind"] for x in rows[3]["links"]] == ["host", "ioc", "ioc"]


def test_filters_and_pages(tables):
    entries, evidence, links = tables
    pick = lambda **q: sorted(r["entry_id"] for r in art.pick_entries(entries, art.EntryQuery(**q), evidence, links).collect())
    assert pick() == [1, 2, 3] and pick(status=("open",)) == [1, 2] and pick(tactic="t1") == [1, 3] and pick(text="FIRST") == [1, 2]
    assert pick(host="WS01") == [1, 3] and pick(host="gone") == [] and pick(row=10) == [1, 3] and pick(row=10, status=("done",)) == [3]
    page = art.entry_page(entries, art.EntryQuery(), evidence, links, limit=2).collect()
    assert [(r["entry_id"], r["position"], r["truncated"]) for r in page] == [(1, 0, True), (3, 1, True)]
    page = art.entry_page(entries, art.EntryQuery(), evidence, links, limit=2, offset=2).collect()
    assert [(r["entry_id"], r["position"], r["truncated"]) for r in page] == [(2, 2, False)]
    for bad in (dict(limit=0), dict(offset=-1)):
        with pytest.raises(ValueError):
            art.entry_page(entries, art.EntryQuery(), evidence, links, **bad)
    with pytest.raises(ValueError):
        pick(text="x" * 1001)


def test_headers_are_exact():
    for kind, header in rec.HEADERS.items():
        assert rec.recognise(header.split(",")) == kind
        assert rec.recognise(header.split(",")[:-1]) is None and rec.recognise(header.lower().split(",")) is None
        assert {rec.SELECTS[kind].path, rec.SELECTS[kind].time} <= set(header.split(","))
    assert rec.recognise([]) is None and [len(h.split(",")) for h in rec.HEADERS.values()] == [21, 20, 7, 34, 27, 5]


def test_candidates_of_files(spark, tmp_path):
    bin_header, cache_header = rec.HEADERS["recycle_bin"], rec.HEADERS["appcompat_cache"]
    texts = {
        "a.csv": f'{bin_header}\ns,f,"C:\\Q, ""x""\\Tool.EXE",1,2024\nshort,row\ns,f,a/b\\,1,2024,too,long\ns,f,,1,\n',
        "b.csv": f"{cache_header}\n1,2,/usr/Bin/LS,2023,yes,no,src\n",
        "c.csv": "other,header\n1,2\n",
        "d.csv": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = rec.candidates_of_files(spark, [(str(tmp_path / n), n, "") for n in texts])
    assert [p.rsplit("/", 1)[1] for p in found.unknown] == ["c.csv", "d.csv"]
    got = sorted((r["host"], r["kind"], r["evidence_path"], r["basename"], r["sha1"], r["evidence_timestamp"]) for r in found.rows.collect())
    assert got == [("a.csv", "recycle_bin", "", "", None, ""), ("a.csv", "recycle_bin", 'C:\\Q, "x"\\Tool.EXE', "tool.exe", None, "2024"), ("b.csv", "appcompat_cache", "/usr/Bin/LS", "ls", None, "2023")]
    assert rec.candidates_of_files(spark, [(str(tmp_path / "c.csv"), "h", "")]).rows.collect() == []


def test_hashes_in_lower_case(spark):
    header = rec.HEADERS["amcache_file_entries"].split(",")
    df = spark.createDataFrame([tuple("AB" if c == "SHA1" else "x\\Y" if c == "FullPath" else "" for c in header), tuple(None for _ in header)], ", ".join(f"`{c}` string" for c in header))
    got = sorted(map(repr, rec.candidates(df, "amcache_file_entries", n=F.lit(1)).collect()))
    assert len(got) == 2 and "sha1='ab'" in got[1] and "sha1=None" in got[0]
