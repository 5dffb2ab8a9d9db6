"""Event rules over the whole XML, and the search box, on odd inputs."""

import pytest

from vestige.operators import payload as pay
from vestige.operators.predicates import FilterError, Term, parse_search, safe_regex, search
from vestige.relation import Relation

NESTED = """<?xml version="1.0"?><!-- <Foo/> --><Event xmlns="urn:e"><System><Provider Name="P"/><EventID Qualifiers="3"> 9 </EventID><Task>9</Task><TimeCreated SystemTime="x"/><Channel>Log</Channel></System>
<EventData><Data>first</Data><Data Name="n">0xab</Data><Data Name="n">again</Data><Binary>0011</Binary></EventData>
<UserData><x:Cleared xmlns:x="urn:x"><x:Who Kind="b">other</x:Who><x:Who Kind="a" Also="1">bob</x:Who><Deep><Deeper>down</Deeper></Deep></x:Cleared></UserData></Event>"""

#: A path, and what the source of the rules gives for it.
PATHS = {
    "/Event/EventData/Data": "first",
    "/Event/EventData/Binary": "0011",
    '/Event/EventData/Data[@Name="n"]': "0xAB",
    '/Event/EventData/Data[@Name="N"]': "",
    "/Event/EventData/Data[@Name='n']": "",
    "/Event/EventData/Data[@Name=n]": "0xAB",
    '/Event/EventData/Data[ Name = "n" ]': "0xAB",
    "/Event/EventData/Data[1]": "",
    '/Event/UserData/Data[@Name="n"]': "",
    "/Event/System/Task": "9",
    "/Event/System/TimeCreated": "",
    "Event/System/Channel": "Log",
    "/System/Channel": "Log",
    "/Other/System/Channel": "",
    "/Event/UserData/Cleared/Who": "other",
    '/Event/UserData/Cleared/Who[@Kind="a"]': "bob",
    '/Event/UserData/Cleared/Who[@Also="1"]': "bob",
    "/Event/UserData/Cleared/Deep/Deeper": "down",
    "/Event/UserData/Cleared/Deep/Deeper/Deepest": "",
    "/Event/UserData//Deep": "",
    "": "",
    '/Event/EventData/Data[@Name="a/b"]': "",
}


def rules(spark, paths, event_id="9"):
    rows = [("Log", event_id, "About", i, "PayloadData1", "", [("v", p)]) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, pay.RULES)


def test_paths_over_the_whole_event(spark):
    events = spark.createDataFrame([(1, NESTED)], "id int, xml string")
    rows = pay.mapped(events, rules(spark, PATHS)).collect()
    # Rows of one event keep the rules' order.
    assert [r["payload"] for r in rows] == list(PATHS.values())


def test_xml_is_parsed_once(spark):
    events = spark.createDataFrame([(1, NESTED)], "id int, xml string")
    for df in (pay.mapped(events, rules(spark, PATHS)), pay.mapped_columns(events, rules(spark, PATHS))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml") == 1


def test_columns_of_odd_events(spark):
    made = [
        ("Log", "9", "About", 1, "PayloadData1", "%a% and %b%", [("a", "/Event/System/Task"), ("b", "/Event/EventData/Data")]),
        ("Log", "9", "About", 2, "UserName", "%a%", [("a", "/Event/EventData/Binary")]),
        ("Log", "9", "About", 3, "UserName", "", [("a", "/Event/EventData/None")]),
        ("Log", "9", "About", 4, "RemoteHost", "fixed", None),
        ("Log", "9", "About", 5, None, None, None),
        ("", "0", "Nothing known", 1, "ExecutableInfo", "bad", None),
    ]
    events = [(1, NESTED), (2, "<Event><System>"), (3, None), (4, "not XML"), (5, "<Event><EventData><Data>x</Data></EventData></Event>"), (6, "<Event><System><Channel>Log</Channel><EventID>8</EventID></System><EventData><Data>x</Data><Data Name='y'/></EventData></Event>"), (7, NESTED.replace("> 9 <", ">4294967296<"))]
    df = pay.mapped_columns(spark.createDataFrame(events, "id int, xml string"), spark.createDataFrame(made, pay.RULES))
    got = {r["id"]: r for r in df.collect()}
    assert (got[1]["MapDescription"], got[1]["PayloadData1"], got[1]["UserName"], got[1]["RemoteHost"], got[1]["PayloadData2"]) == ("About", "9 and first", "", "fixed", "")
    for k in (2, 3, 4, 5):  # no channel, and so number 0
        assert (got[k]["MapDescription"], got[k]["ExecutableInfo"], got[k]["PayloadData1"]) == ("Nothing known", "bad", "")
    assert (got[6]["MapDescription"], got[6]["PayloadData1"], got[6]["PayloadData2"]) == ("", "x", "y: ")
    assert (got[7]["MapDescription"], got[7]["PayloadData1"], got[7]["PayloadData4"]) == ("", "first", "Binary"[:0])


def test_no_rules_and_no_events(spark):
    none = spark.createDataFrame([], pay.RULES)
    events = spark.createDataFrame([(1, NESTED)], "id int, xml string")
    assert [tuple(r)[2:] for r in pay.mapped(events, none).collect()] == [("Log", "9", "", "", "")]
    assert pay.mapped_columns(events, none).first()["PayloadData2"] == "n: 0xab"
    assert pay.mapped(events.limit(0), rules(spark, PATHS)).collect() == []


def test_too_many_shapes_and_names_apart_by_case(spark, monkeypatch):
    monkeypatch.setattr(pay, "MOST_SHAPES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        pay.shapes_of(rules(spark, [f"/Event/System/X{i}" for i in range(4)]))
    with pytest.raises(ValueError, match="case"):
        pay.schema_of(["/Event/System/Task", "/Event/System/task"])


COLUMNS = ["EventId", "PayloadData1", "plain", "Remote Host", "a:b", "eventid"]


@pytest.mark.parametrize(
    "text, terms",
    [
        ("one two", [Term("", None, "one"), Term("", None, "two")]),
        ('mimikatz +"Bad Guy" -mark', [Term("", None, "mimikatz"), Term("+", None, "Bad Guy"), Term("-", None, "mark")]),
        ("eventid:4624 kali", [Term("", "EventId", "4624"), Term("", None, "kali")]),
        ("http://x", [Term("", None, "http://x")]),
        ('"unterminated quote', [Term("", None, "unterminated quote")]),
        ('+PayloadData1:"svch0st.exe:443"', [Term("+", "PayloadData1", "svch0st.exe:443")]),
        ("EventId:", [Term("", None, "EventId:")]),
        ('EventId:""', [Term("", None, "EventId:")]),
        ('"Remote Host":srv', [Term("", None, "Remote Host:srv")]),
        ("a:b:vvv", [Term("", None, "a:b:vvv")]),
        ('"plain":x', [Term("", None, "plain:x")]),
        ('"+x" "-y"', [Term("", None, "+x"), Term("", None, "-y")]),
        ("+ - : a: :b ++--", [Term("", None, "+"), Term("", None, "-"), Term("", None, ":"), Term("", None, "a:"), Term("", None, ":b"), Term("+", None, "+--")]),
        ('"" +"" -"" ', []),
        ("Security\x1fWS01", [Term("", None, "Security\x1fWS01")]),
        ('pre"fix in"side next', [Term("", None, "prefix inside"), Term("", None, "next")]),
        ('"' * 1999, []),
    ],
)
def test_terms(text, terms):
    assert parse_search(text, COLUMNS) == terms


def test_limits_of_a_search():
    assert len(parse_search(" ".join(["x"] * 50), [])) == 50
    for bad in (" ".join(["x"] * 51), "a" * 2001):
        with pytest.raises(FilterError):
            parse_search(bad, [])
    assert len(parse_search("a" * 2000, [])) == 1


def test_search_over_rows(spark):
    rows = [(1, "http://x/1", "WS01", "run1"), (2, "note:see", "ws02", "run1"), (3, None, "SRV", "run1"), (4, "50%_\\", "SRV", "run1"), (5, "second\nline", "", "run1")]
    df = spark.createDataFrame(rows, "id int, Note string, host string, _run string")
    r = Relation("t", df, "host", None, "id", ("Note",))
    hits = lambda text, **o: [x["id"] for x in df.where(search(text, r, **o)).orderBy("id").collect()]
    assert hits("http://x") == [1] and hits("note:see") == [2] and hits("NOTE:SEE") == [2] and hits("_run:run1") == [1, 2, 3, 4, 5]
    assert hits("run1") == [] and hits("ws0") == [1, 2] and hits("-ws0") == [3, 4, 5] and hits("ws0", case_sensitive=True) == [2]
    assert hits("%") == [4] and hits("_") == [4] and hits("\\") == [4] and hits("-note:see") == [1, 3, 4, 5]
    assert hits("^ws", regex=True) == [1, 2] and hits("^ws", regex=True, case_sensitive=True) == [2] and hits("1$", regex=True) == [1] and hits(" ", regex=True) == [1, 2, 3, 4, 5]
    for bad in ("(", "(a+)+$", "x" * 2001):
        with pytest.raises(FilterError):
            search(bad, r, regex=True)


@pytest.mark.parametrize("pattern", [r"(a|a)*$", r"(a|aa)+$", r"(?:x|[xy])*", r"(\w|\d){2,}", r"(a|)+", r"((a|b)|a)*", r"(.|a)+b", r"(a+)+"])
def test_patterns_of_exponential_time_are_refused(pattern):
    with pytest.raises(FilterError):
        safe_regex(pattern, True)


@pytest.mark.parametrize("pattern", [r"(foo|bar)+", r"(?:\\|/)*x", r"[(|)]+", r"\(a|a\)+", r"(a|b)?", r"(a|aa){1,3}", r"^(ERR|si).*", r"(?:ab|cd|ef)*$"])
def test_other_patterns_are_allowed(pattern):
    assert safe_regex(pattern, False) == pattern
