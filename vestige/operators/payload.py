"""Event XML: its named data, its payload as JSON, and a user's rules over the whole event. Built-in functions only.

Rules name values by path. The paths that a set of rules uses are compiled,
before anything is read, to one schema, with which each event's XML is parsed
once, and to one expression for each *shape* of path: its element and
attribute names without the attribute values that it asks for, which stay data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vestige.functions.text import normalised_scalar
from vestige.operators.lookups import sized

#: A rule: the events it is for, its place among their rules, the column it fills, with what, and values taken by path.
RULES = "channel string, event_id string, description string, at int, property string, template string, values array<struct<name:string,path:string>>"
#: Columns that rules fill; of the data of an event without rules the first fill ``PayloadData1`` and on.
SLOTS = [f"PayloadData{i}" for i in range(1, 7)]
PROPERTIES = ["UserName", "RemoteHost", "ExecutableInfo", *SLOTS]
#: What is read of every event, whatever the rules.
BASE = [*[f"/Event/System/{x}" for x in ("Channel", "EventID", "Computer", "Level", "EventRecordID")], "/Event/EventData/Data[@Name=]", "/Event/UserData/Data[@Name=]"]
#: Shapes of paths in one set of rules: each is an expression of the plan.
MOST_SHAPES = 1000
ROOT = r"^\s*(?:<\?[^>]*>\s*|<!--(?s:.*?)-->\s*|<![A-Za-z][^>]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)"


def shape_of(path: Column) -> Column:
    """A path without the attribute values it asks for; null for one that asks for a value with ``/``, which finds nothing."""
    return F.when(~path.rlike(r"\[[^\]]*/"), F.regexp_replace(path, r"(\[[^=\]]*=)[^\]]*\]", "$1]"))


def asked_of(path: Column) -> Column:
    """The attribute values that a path asks for, in order, without the double quotes around."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"\[[^=\]]*=([^\]]*)\]")), lambda x: F.btrim(F.trim(x), F.lit('"')))


def steps(shape: str) -> list[tuple[str, str | None]]:
    """(element, attribute or None) of each step of a shape."""
    out = []
    for step in shape.lstrip("/").split("/"):
        asked = re.fullmatch(r"([^\[]*)\[.([^=]*)=.*\]", step)
        out.append((asked[1], asked[2].strip()) if asked else (step, None))
    return out


@dataclass
class Element:
    """What is read of an element: its text, attributes, and elements inside."""

    attributes: set[str] = field(default_factory=set)
    inside: dict[str, Element] = field(default_factory=dict)

    def reach(self, path: list[tuple[str, str | None]]) -> None:
        here = self
        for name, attribute in path:
            here = here.inside.setdefault(name, Element())
            if attribute:
                here.attributes.add(attribute)

    def schema(self, root: bool = False) -> T.StructType:
        own = [] if root else [T.StructField(f"_{a}", T.StringType()) for a in sorted(self.attributes)] + [T.StructField("_VALUE", T.StringType())]
        names = [f.name.lower() for f in own] + [n.lower() for n in self.inside]
        if len(names) != len(set(names)):
            raise ValueError(f"names that differ only in case: {', '.join(sorted(self.inside))}")
        return T.StructType(own + [T.StructField(n, T.ArrayType(e.schema())) for n, e in self.inside.items()])


def variants(shape: str) -> tuple[str, list[tuple[str, str | None]], list[tuple[str, str | None]]]:
    """The name of a root that a path may start with, the steps below that root, and those below any other."""
    path = steps(shape)
    return path[0][0].split("[")[0], path[1:], path


def schema_of(shapes: list[str]) -> T.StructType:
    tree = Element()
    for shape in shapes:
        _, below, whole = variants(shape)
        tree.reach(below)
        tree.reach(whole)
    return tree.schema(root=True)


def parsed(events: DataFrame, xml: str, shapes: list[str] | None = None) -> DataFrame:
    """``events`` with ``event``, the parts of the XML that the shapes and ``BASE`` name, and ``event_root``, the name of its root.

    Names are taken without prefix. Parts are null where there are none, and all of them if the text isn't XML.
    """
    schema = schema_of(list(dict.fromkeys([*BASE, *(shapes or [])])))
    options = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "ignoreNamespace": "true"}
    return events.withColumn("event", F.from_xml(F.col(xml), schema, options)).withColumn("event_root", F.regexp_extract(xml, ROOT, 1))


def _walk(path: list[tuple[str, str | None]], asked: Column) -> Column:
    """The text of the element at the end of ``path``: of each step the first element with the name and the asked attribute."""
    here, nth = F.col("event"), 0
    for name, attribute in path:
        found = here[name]
        if attribute:
            wanted = F.get(asked, F.lit(nth))
            found = F.filter(found, lambda e: e[f"_{attribute}"] == wanted)  # noqa: B023 (used at once)
            nth += 1
        here = F.get(found, F.lit(0))
    return here["_VALUE"]


def system(name: str) -> Column:
    """One of the System fields of ``BASE``."""
    return F.get(F.get("event.System", F.lit(0))[name], F.lit(0))["_VALUE"]


def event_code() -> Column:
    """The event id as a number without sign; 0 if it isn't one."""
    text = F.trim(F.coalesce(system("EventID"), F.lit("")))
    number = F.regexp_replace(F.when(text.rlike(r"^\+?[0-9]+$"), text), r"^\+?0*(?=[0-9])", "")
    return F.when((F.length(number) <= 10) & (number.try_cast("long") <= 4_294_967_295), number).otherwise("0")


def looked_up(shape: Column, asked: Column, shapes: list[str]) -> Column:
    """The value at a path (by its shape and asked values): the text of the first element that fits at every step; empty if there is none."""
    out = None
    for known in shapes:
        root, below, whole = variants(known)
        here = F.when(F.col("event_root") == root, _walk(below, asked)).otherwise(_walk(whole, asked)) if below else F.when(F.col("event_root") != root, _walk(whole, asked))
        out = F.when(shape == known, here) if out is None else out.when(shape == known, here)
    return F.coalesce(normalised_scalar(out), F.lit("")) if out is not None else F.lit("")


def _data(container: str) -> Column:
    first = F.get(f"event.{container}", F.lit(0))
    items = F.transform(first["Data"], lambda d: F.struct(d["_Name"].alias("_Name"), d["_VALUE"].alias("_VALUE")))
    return F.coalesce(items, F.array().cast("array<struct<_Name:string,_VALUE:string>>"))


def payload(xml: Column | str = "xml") -> Column:
    """The event's data as JSON: ``{"EventData":{"Data":[{"@Name":"x","#text":"y"}]}}``; empty without data. Of both containers EventData."""
    name = xml if isinstance(xml, str) else "xml"

    def shown(container: str) -> Column:
        items = F.transform(_data(container), lambda d: F.struct(d["_Name"].alias("@Name"), normalised_scalar(d["_VALUE"]).alias("#text")))
        return F.to_json(F.struct(F.struct(items.alias("Data")).alias(container)))

    return F.when(F.contains(name, F.lit("<EventData")), shown("EventData")).when(F.contains(name, F.lit("<UserData")), shown("UserData")).otherwise("")


def first_data(most: int = 6) -> Column:
    """The first data of EventData, each as ``Name: value``, or as its value if it has no name."""
    shown = F.transform(_data("EventData"), lambda d: F.when(F.coalesce(d["_Name"], F.lit("")) == "", F.coalesce(d["_VALUE"], F.lit(""))).otherwise(F.concat(d["_Name"], F.lit(": "), F.coalesce(d["_VALUE"], F.lit("")))))
    return F.slice(shown, 1, most)


def shapes_of(rules: DataFrame) -> list[str]:
    """The distinct shapes of the rules' paths, a list that ``MOST_SHAPES`` bounds."""
    found = rules.select(F.explode("values").alias("v")).select(shape_of(F.col("v.path")).alias("shape")).where("shape IS NOT NULL").distinct()
    shapes = sorted(r["shape"] for r in found.limit(MOST_SHAPES + 1).collect())
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"more than {MOST_SHAPES} shapes of paths in one set of rules")
    return [s for s in shapes if all(name for name, _ in steps(s))]


def _compiled(rules: DataFrame) -> DataFrame:
    """One row for each channel and event id: its description and its rules in order, with the paths taken apart."""
    values = F.transform("values", lambda v: F.struct(v["name"].alias("name"), shape_of(v["path"]).alias("shape"), asked_of(v["path"]).alias("asked")))
    rule = F.struct("at", F.coalesce("property", F.lit("")).alias("property"), F.coalesce("template", F.lit("")).alias("template"), F.coalesce(values, F.array().cast("array<struct<name:string,shape:string,asked:array<string>>>")).alias("values"))
    of_event = rules.withColumn("rule", rule).groupBy("channel", F.col("event_id").alias("event_code"))
    return of_event.agg(F.max_by("description", "at").alias("description"), F.array_sort(F.collect_list("rule")).alias("rules"))


def _filled(rule: Column, shapes: list[str]) -> Column:
    """A rule's template with each ``%name%`` replaced, one after another; without a template the first value."""
    taken = F.transform(rule["values"], lambda v: F.struct(v["name"].alias("name"), looked_up(v["shape"], v["asked"], shapes).alias("text")))
    filled = F.aggregate(taken, rule["template"], lambda acc, v: F.replace(acc, F.concat(F.lit("%"), v["name"], F.lit("%")), v["text"]))
    return F.when(filled != "", filled).otherwise(F.coalesce(F.get(taken, F.lit(0))["text"], F.lit("")))


def _matched(events: DataFrame, rules: DataFrame, xml: str) -> tuple[DataFrame, list[str]]:
    shapes = shapes_of(rules)
    read = parsed(events, xml, shapes)
    known = read.withColumns({"channel": F.coalesce(system("Channel"), F.lit("")), "event_code": event_code()})
    return known.join(sized(_compiled(rules)), ["channel", "event_code"], "left"), shapes


def mapped(events: DataFrame, rules: DataFrame, xml: str = "xml") -> DataFrame:
    """``events`` and, a row for each rule of their channel and event id, its description, property and filled template (``payload``).

    Events without a rule have one row, with empty texts.
    """
    met, shapes = _matched(events, rules, xml)
    each = met.withColumn("rule", F.explode_outer("rules"))
    text = F.when(F.col("rule").isNotNull(), _filled(F.col("rule"), shapes)).otherwise("")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return each.select(*events.columns, "channel", "event_code", empty(F.col("description")).alias("description"), empty(F.col("rule.property")).alias("property"), text.alias("payload"))


def mapped_columns(events: DataFrame, rules: DataFrame, xml: str = "xml") -> DataFrame:
    """``events`` with ``MapDescription`` and the columns of ``PROPERTIES``, one row each.

    Of several rules for one column the last fills it, with an empty text too; a rule may fill
    the description. Events without rules have their first data in the slots.
    """
    met, shapes = _matched(events, rules, xml)
    filled = met.withColumn("filled", F.transform("rules", lambda r: F.struct(r["property"].alias("property"), _filled(r, shapes).alias("text"))))
    last = lambda name: F.try_element_at(F.filter("filled", lambda x: x["property"] == name), F.lit(-1))["text"]
    raw = first_data(len(SLOTS))
    columns = {p: F.coalesce(last(p), F.lit("")) for p in PROPERTIES}
    columns |= {p: F.when(F.col("rules").isNull(), F.coalesce(F.get(raw, F.lit(i)), F.lit(""))).otherwise(columns[p]) for i, p in enumerate(SLOTS)}
    description = F.coalesce(last("MapDescription"), "description", F.lit(""))
    return filled.select(*events.columns, description.alias("MapDescription"), *[c.alias(p) for p, c in columns.items()])
