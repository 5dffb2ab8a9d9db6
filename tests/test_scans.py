"""Scans grouped by header, with provenance by file."""

import pytest

from vestige.sources import tables as src


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan csv")


def test_as_many_scans_as_headers(spark, tmp_path):
    files = []
    for i in range(500):
        header, row = ("A,B", f"{i},x") if i % 5 else ("B,C", f"y,{i}")
        name = tmp_path / f"h {i}+%25é.csv"
        name.write_text(f"{header}\n{row}\n")
        files.append((str(name), f"H{i}", f"user:u{i}" if i % 2 else None))
    df = src.scan_text(spark, files, "run1")
    assert scans(df) == 2
    got = {r["_host"]: r for r in df.collect()}
    assert len(got) == 500
    for i in range(500):
        r = got[f"H{i}"]
        assert (r["A"], r["B"], r["C"], r["_run_id"], r["_identity"]) == ((str(i), "x", None) if i % 5 else (None, "y", str(i))) + ("run1", f"user:u{i}" if i % 2 else None)
        assert r["_output_file"].endswith(f"/h {i}+%25é.csv")
    table = spark.createDataFrame(files, src.FILES)
    assert sorted(map(tuple, src.scan_text(spark, table, "run1").collect()), key=repr) == sorted(map(tuple, got.values()), key=repr)


def test_odd_headers(spark, tmp_path):
    texts = {"clash": "_Host,a,A,,_at\n1,2,3,4,5\n", "empty": "", "only": "x,y\n", "line": '"two\nlines",b\n"v\nw",2\n', "bom": "﻿x,y\n7,8\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    df = src.scan_text(spark, [(str(tmp_path / n), n, "") for n in texts], "r", multi_line=True)
    assert df.columns[-4:] == ["_run_id", "_host_1", "_identity", "_output_file"]
    got = {r["_host_1"]: r.asDict() for r in df.collect()}
    assert sorted(got) == ["bom", "clash", "line"]
    assert [got["clash"][c] for c in ("_Host", "a", "A_1", "column3", "_at")] == ["1", "2", "3", "4", "5"]
    assert got["line"]["two\nlines"] == "v\nw" and got["bom"]["x"] == "7"
    assert src.scan_text(spark, [(str(tmp_path / "empty"), "h", "")], "r").collect() == []
    assert src.scan_text(spark, [], "r").columns == src.PROVENANCE


def test_folders_and_limits(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        for k in range(2):
            (tmp_path / f"d{i}" / f"p{k}.csv").write_text(f"k{i}\n{k}\n")
    (tmp_path / "single.csv").write_text("k0\n9\n")
    files = [(str(tmp_path / f"d{i}"), f"H{i}", "") for i in range(3)] + [(str(tmp_path / "single.csv"), "S", "")]
    rows = src.scan_text(spark, files, "r").collect()
    assert sorted((r["_host"], r["k0"], r["k1"], r["k2"]) for r in rows if r["_host"] in ("H0", "S")) == [("H0", "0", None, None), ("H0", "1", None, None), ("S", "9", None, None)]
    assert len(rows) == 7
    monkeypatch.setattr(src, "MOST_HEADERS", 2)
    with pytest.raises(ValueError, match="headers"):
        src.scan_text(spark, files, "r")


def test_merge_of_users_files(spark, tmp_path):
    for user, text in (("a", "k,v\n1,x\n"), ("b", "k,v\n2,y\n"), ("c", "v,k\nz,3\n"), ("d", "")):
        (tmp_path / user).write_text(text)
    merged = src.merge_user_files(spark, [("alice", str(tmp_path / "a")), ("", str(tmp_path / "b")), ("none", str(tmp_path / "d"))])
    assert merged.columns == ["k", "v", "TriageUser"] and scans(merged) == 1
    assert sorted(map(tuple, merged.collect())) == [("1", "x", "alice"), ("2", "y", "system")]
    with pytest.raises(ValueError, match="differ"):
        src.merge_user_files(spark, [("alice", str(tmp_path / "a")), ("carl", str(tmp_path / "c"))])
