"""Indicators, identifiers, accounts and offers on odd texts."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from vestige.functions import indicators as ind
from vestige.operators import offers, records
from vestige.relation import Relation


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_addresses_as_a_library_writes_them(spark):
    rnd = random.Random(7)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1::8:9:a:b:c:d:e", "1:2:3:4:5:6:7:8::", ":::", "1:::2", ":1", "1:", "1::2::3", "12345::", "g::", "::1.2.3.4", "::ffff:1.2.3.4", "::ffff:0:0", "1.2.3.4::", "::1.2.3", "::1.2.3.256", "::01.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "64:ff9b::1.2.3.4", "", " ::1", "::1 ", "fe80::1%1", "[::1]", "0:0:0:0:0:0:0:0", "1:0:0:4:0:0:0:8", "1:0:0:4:5:0:0:8", "1:0:3:0:5:0:7:0"]
    for _ in range(400):
        groups = [rnd.choice(["0", "0", "0000", "1", "Ff", f"{rnd.getrandbits(16):x}", f"{rnd.getrandbits(16):04X}"]) for _ in range(rnd.randint(5, 9))]
        if rnd.random() < 0.5:
            groups[rnd.randrange(len(groups))] = ""
        if rnd.random() < 0.2:
            groups[-1] = f"{rnd.randint(0, 300)}.2.3.{rnd.randint(0, 12)}"
        texts.append(":".join(groups).replace("::::", "::"))

    def library(text):
        if "%" in text:
            return None
        try:
            found = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return f"::ffff:{found.ipv4_mapped}" if found.ipv4_mapped else str(found)

    got = values(spark, texts, ind.ipv6_text(ind.ipv6_groups(F.col("t"))))
    assert [g[0] for g in got] == [library(t) for t in texts]


CASES = {
    "ip": {"1.2.3.4": "1.2.3.4", "1.2.3.04": None, "256.1.1.1": None, "ABCD::1": "abcd::1", "1.2.3.4\n": None},
    "domain": {"A-b.C": "a-b.c", "localhost": "localhost", "a..b": None, ".a": None, "a.": None, "a_b": None, "x" * 63: "x" * 63, "x" * 64: None, ".".join(["x" * 63] * 4): None, "é.fr": None, "": None},
    "hostname": {"WS01": "ws01", "a b": None},
    "url": {"http://a": "http://a", "FTP://u@a:1@b.c:65535/p": "FTP://u@a:1@b.c:65535/p", "http://b:65536": None, "http://b:": None, "http://b:0000000000000000080": "http://b:0000000000000000080", "http://": None, "http:///x": None, "http://[::1]": "http://[::1]", "http://[::1]:80/x": "http://[::1]:80/x", "http://[::1]x": None, "http://[::g]": None, "http://1.2.3.4:80": "http://1.2.3.4:80", "ssh://a": None, "http://a b": None, "http://a\u00a0b": None, "a://b": None, "http://a?b:c@d": "http://a?b:c@d", "http://x_y": None},
    "email": {"a@b": "a@b", "A.b+c@D.org": "A.b+c@D.org", "a@b@c": None, "@b": None, "a b@c": None, "x" * 64 + "@b": "x" * 64 + "@b", "x" * 65 + "@b": None, "a@": None},
    "md5": {"A" * 32: "a" * 32, "a" * 31: None, "g" * 32: None},
    "sha1": {"A" * 40: "a" * 40, "A" * 41: None},
    "sha256": {"0" * 64: "0" * 64, " " + "0" * 64: None},
    "file_name": {"x.exe": "x.exe", "a/b": None, "a\\b": None, "a\tb": "a\tb"},
    "other": {"x" * 4096: "x" * 4096, "x" * 4097: None, " \u3000": None, "a\x00b": None, "a\x85b": None, "  a ": "  a "},
}


@pytest.mark.parametrize("kind", CASES)
def test_kinds(spark, kind):
    got = values(spark, CASES[kind], ind.indicator(kind, F.col("t")))
    assert [g[0] for g in got] == list(CASES[kind].values())


def test_guesses_identifiers_and_accounts(spark):
    assert [g[0] for g in values(spark, ["A" * 64, "A" * 40, "A" * 32, "::1", "http://a", "a@b", "a", "a b", None, ""], ind.guessed_kind(F.col("t")))] == ["sha256", "sha1", "md5", "ip", "url", "email", "domain", None, None, None]
    sids = {"S-1-5-18": "S-1-5-18", "s-1-005-0021": "S-1-5-21", "S-1-5": None, "S-2-5-1": None, "S-1-5-4294967296": None, "S-1-281474976710655-0": "S-1-281474976710655-0", "S-1-281474976710656-0": None, "S-1-5" + "-1" * 15: "S-1-5" + "-1" * 15, "S-1-5" + "-1" * 16: None, "S-1-5--1": None, "S-1-5-1-": None, "S-1-5-99999999999999999999": None, "S-01-5-1": None}
    assert [g[0] for g in values(spark, sids, ind.sid(F.col("t")))] == list(sids.values())
    accounts = {"jdoe": (None, "jdoe"), "ACME\\jdoe": ("ACME", "jdoe"), "a\\b\\jdoe": ("a\\b", "jdoe"), "-\\jdoe": (None, "jdoe"), "\\jdoe": (None, "jdoe"), " - \\jdoe": (None, "jdoe"), "": None, " ": None, "-": None, "-\\-": None, "ACME\\": None, "ACME\\ ": None, "a\x00b": None, "x" * 257: None, "x" * 256: (None, "x" * 256), "x" * 257 + "\\a": None, "a\nb\\c": None}
    got = values(spark, accounts, ind.account(F.col("t")))
    assert [g[0] and tuple(g[0]) for g in got] == list(accounts.values())


def test_which_relations_a_taker_reads():
    fits = lambda pattern, name: offers.Taker(pattern, "c", "ip").fits(name)
    assert fits("log", "log") and not fits("log", "log2") and fits("log_*", "log_") and fits("log_*", "log_x")
    assert fits("a_*_b", "a_x_b") and not fits("a_*_b", "a__b") and not fits("a_*_b", "a_x_b2") and not fits("a.c", "abc")


def test_offers_of_rows(spark):
    rows = [
        (1, "ACME\\jdoe", "Target: acme\\JDOE", "WS (x) (::FFFF:1.2.3.4)", "C:\\x", "s-1-5-21"),
        (2, None, "Target: -", "1.2.3.4", None, None),
        (3, "jdoe", "target: a", "- (-)", "\n", "bad"),
        (4, "other\\jdoe", "Target: x\\y", "WS (1.2.3.4", "same", None),
    ]
    df = spark.createDataFrame(rows, "id int, who string, target string, remote string, path string, sid string")
    takers = [offers.Taker("r*", "who", "account", "sid"), offers.Taker("r", "target", "logon_target"), offers.Taker("r", "remote", "address"), offers.Taker("r", "path", "file_path"), offers.Taker("other", "who", "domain"), offers.Taker("r", "absent", "ip")]
    relation = Relation("r", df, None, None, "id")
    accounts = spark.createDataFrame([(10, "JDoe", "acme"), (11, "jdoe", None), (12, "jdoe", ""), (9, "JDOE", "Acme")], "id long, name string, domain string")
    iocs = spark.createDataFrame([(20, "ip", "1.2.3.4"), (21, "file_path", "c:\\X"), (22, "domain", "1.2.3.4")], "id long, type string, value string")
    got = sorted((r["row_id"], r["nth"], r["kind"], r["ioc_type"], r["value"], r["domain"], r["sid"], r["column"], r["existing_id"]) for r in offers.candidates([(relation, "path")], takers, accounts, iocs).collect())
    assert got == [
        (1, 0, "account", None, "jdoe", "ACME", "S-1-5-21", "who", 9),
        (1, 1, "ioc", "ip", "::ffff:1.2.3.4", None, None, "remote", None),
        (1, 2, "ioc", "file_path", "C:\\x", None, None, "path", 21),
        (2, 0, "ioc", "ip", "1.2.3.4", None, None, "remote", 20),
        (3, 0, "account", None, "jdoe", None, None, "who", 11),
        (4, 0, "account", None, "jdoe", "other", None, "who", 11),
        (4, 1, "account", None, "y", "x", None, "target", None),
        (4, 2, "ioc", "file_path", "same", None, None, "path", None),
    ]
    alone = offers.candidates([(relation, None)], takers[:1]).collect()
    assert {r["existing_id"] for r in alone} == {None} and len(alone) == 3
    assert offers.candidates([(Relation("none", df, None, None, "id"), None)], takers).collect() == []


def test_record_seen_counts_repeats_once_and_expands_nothing(spark):
    links = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 11), (2, 12), (3, 13), (3, None), (None, 10), (4, 99)], "record_id long, entry_id long")
    entries = spark.createDataFrame([(10, 5, "b", False), (10, 3, "a", False), (10, 4, "a", False), (11, 7, None, False), (11, 1, "c", True), (12, None, "b", False), (13, 1, "a", True), (None, 1, "z", False)], "entry_id long, at int, host string, deleted boolean")
    out = records.record_seen(links, entries)
    want = [(1, 2, 3, 7, "a, b", 2), (2, 2, 7, 7, "b", 1), (None, 1, 3, 5, "a, b", 2)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert records.record_seen(links.limit(0), entries).count() == 0
    # No row is copied for each thing that is counted.
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_offers_read_a_cell_once(spark):
    df = spark.createDataFrame([(1, "A" * 40, "ACME\\x", "WS (10.0.0.1)"), (2, "no", "-", "WS ()"), (3, None, None, None)], "i long, sha string, user string, host string")
    takers = [offers.Taker("log*", "sha", "sha1"), offers.Taker("log*", "user", "account"), offers.Taker("log*", "host", "address")]
    got = offers.offers(Relation("log", df, None, None, "i"), takers)
    assert sorted((r["row_id"], r["nth"], r["value"], r["domain"]) for r in got.collect()) == [(1, 0, "a" * 40, None), (1, 1, "x", "ACME"), (1, 2, "10.0.0.1", None)]
    for taker, read in ((takers[0], ind.indicator("sha1", F.col("sha"))), (takers[1], ind.account(F.col("user")))):
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (offers.offers(Relation("log", df, None, None, "i"), [taker]), df.select(read.alias("r")))]
        assert plans[0].count("RLIKE") == plans[1].count("RLIKE") > 0
