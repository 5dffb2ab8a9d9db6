"""Reports over artefact tables: what rows point to, facts of hosts, logons, searches, annotations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.functions import text as tx
from vestige.operators.lookups import enrich, sized
from vestige.operators.predicates import safe_regex
from vestige.operators.storage import checkpointed

# What tells that a log was cleared, and accounts that a stack of logons leaves out.
CLEARING = [("Security", 1102), ("System", 104), ("System", 1100)]
LOGONS = {4624: "success", 4625: "failed"}
OWN_ACCOUNTS = ["SYSTEM", "ANONYMOUS LOGON"]
NOT_FOUND = "(not found)"
#: 1601-01-01 in microseconds since 1970: a time that was never set.
UNSET = -11_644_473_600_000_000


@dataclass(frozen=True)
class Step:
    """A table that rows point to. ``keys``: columns of the rows so far, and the table's columns that they name."""

    table: DataFrame
    keys: dict[str, str]
    note: str = ""
    required: bool = False


def follow(rows: DataFrame, *steps: Step, note: str = "note") -> DataFrame:
    """``rows`` with the columns of the tables that they point to, one step after another; what isn't there is null.

    A key that a table holds several times gives a row for each; a null key points
    nowhere. ``note`` is the note of the first step that found nothing, else the
    empty text. A required step drops rows that it finds nothing for. Names of
    columns other than the keys must differ.
    """
    out, notes = rows, []
    for i, step in enumerate(steps):
        own = {ours: f"_{i}_{ours}" for ours in step.keys}
        named = [F.col(theirs).alias(own[ours]) for ours, theirs in step.keys.items()]
        rest = [c for c in step.table.columns if c not in step.keys.values()]
        there = step.table.select(*named, *rest, F.lit(True).alias(f"_{i}"))
        out = out.join(there, [F.col(ours) == F.col(key) for ours, key in own.items()], "inner" if step.required else "left").drop(*own.values())
        notes.append(F.when(F.col(f"_{i}").isNull(), step.note))
    return out.withColumn(note, F.coalesce(*notes, F.lit(""))).drop(*[f"_{i}" for i in range(len(steps))])


def across(left: DataFrame, bridge: DataFrame, right: DataFrame, left_keys: tuple[str, str], right_keys: tuple[str, str]) -> DataFrame:
    """Distinct pairs of rows that a bridge table links. ``left_keys``: the left table's key and the bridge's; ``right_keys``: the bridge's and the right one's."""
    links = bridge.select(F.col(left_keys[1]).alias("_left"), F.col(right_keys[0]).alias("_right")).distinct()
    return left.join(links, F.col(left_keys[0]) == F.col("_left")).join(right, F.col("_right") == F.col(right_keys[1])).drop("_left", "_right").distinct()


def holds(text: str, regex: bool = False) -> Callable[[Column], Column]:
    """A test for a text, or a pattern, in whatever case."""
    return lambda c: c.rlike(safe_regex(text, True)) if regex else F.contains(F.lower(c), F.lit(text.lower()))


def registry_hits(df: DataFrame, cells: dict[str, str], test: Callable[[Column], Column]) -> DataFrame:
    """A row for each cell that passes ``test``, with its ``hit_type``. ``cells``: type and column, such as key, value and data."""
    hits = F.array_compact(F.array(*[F.when(test(F.col(c)), F.lit(kind)) for kind, c in cells.items()]))
    return df.withColumn("hit_type", F.explode(hits))


def with_keyword(df: DataFrame, lists: list[str], word: str) -> DataFrame:
    """Rows with the word in any text of any of the array columns ``lists``."""
    found = [F.coalesce(F.exists(c, holds(word)), F.lit(False)) for c in lists]
    condition = found[0]
    for more in found[1:]:
        condition = condition | more
    return df.where(condition)


def host_facts(df: DataFrame, host: str, path: str, name: str, value: str, order: str, facts: list[tuple[str, str, str]]) -> DataFrame:
    """(host, label, fact) of every host: the first row, by ``order``, with a fact's value name whose path ends as it says, else ``(not found)``.

    ``facts``: label, end of the path, value name.
    """
    labels = F.array_compact(F.array(*[F.when(F.endswith(F.col(path), F.lit(end)) & (F.col(name) == which), F.lit(label)) for label, end, which in facts]))
    found = df.select(host, F.explode(labels).alias("label"), value, order).groupBy(host, "label").agg(F.min_by(value, order).alias("fact"))
    wanted = df.select(host).distinct().select(host, F.explode(F.array(*[F.lit(label) for label, _, _ in facts])).alias("label"))
    return wanted.join(found, [host, "label"], "left").withColumn("fact", F.coalesce("fact", F.lit(NOT_FOUND)))


def profiles(df: DataFrame, host: str, path: str, name: str, key: str, image: str) -> DataFrame:
    """Distinct (host, sid, profile) from the rows of the profile list, whose cells hold ``KeyName: `` and ``ProfileImagePath: ``."""
    rows = df.where((F.col(name) == "Multiple") & F.endswith(F.col(path), F.lit("ProfileList")) & F.startswith(F.col(key), F.lit("KeyName: ")) & F.startswith(F.col(image), F.lit("ProfileImagePath: ")))
    return rows.select(host, F.substr(key, F.lit(10)).alias("sid"), F.substr(image, F.lit(19)).alias("profile")).distinct()


def expand_folders(rows: DataFrame, path: str, known: DataFrame, name: str = "expanded") -> DataFrame:
    """``rows`` with paths to programs whose first part, a GUID in braces, is replaced by its folder's name; all else is the empty text.

    ``known``: guid (in braces), folder.
    """
    guid = F.when(F.contains(F.col(path), F.lit(".exe")), F.lower(F.nullif(F.regexp_extract(path, r"^(\{[^\\]*)", 1), F.lit(""))))
    found = enrich(rows.withColumn("_guid", guid), known.select(F.lower("guid").alias("_guid"), F.col("folder").alias("_folder")), ["_guid"], ["_folder"])
    return found.withColumn(name, F.when(F.col("_folder") != "", F.concat("_folder", F.substr(path, F.length("_guid") + 1))).otherwise("")).drop("_guid", "_folder")


def log_cleared(df: DataFrame, channel: str, code: str, time: str) -> DataFrame:
    """The events that tell of a cleared or ended log, in time order."""
    condition = F.lit(False)
    for name, number in CLEARING:
        condition = condition | ((F.col(channel) == name) & (F.col(code) == number))
    return df.where(condition).orderBy(F.col(time).asc_nulls_last())


def counted(df: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Rows for each combination of ``by``, commonest first."""
    return df.groupBy(*[c.alias(name) for name, c in by.items()]).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def stack_logons(df: DataFrame, user: str, by: dict[str, Column], filtered: bool = True) -> DataFrame:
    """Logons counted by ``by``; ``filtered`` leaves out the system's own accounts, and machines' (a ``$`` at the end)."""
    name = F.coalesce(F.trim(user), F.lit(""))
    return counted(df.where(~name.isin(OWN_ACCOUNTS) & ~name.endswith("$")) if filtered else df, by)


def logon_summary(df: DataFrame, host: str, code: str, target: str, kind: str) -> DataFrame:
    """(domain, account, outcome, logon_type, host, n) of logon events; rows whose target is no account have a null account."""
    outcome = F.element_at(F.create_map(*[F.lit(x) for pair in LOGONS.items() for x in pair]), F.col(code).cast("int"))
    domain, account = tx.logon_target(F.col(target))
    rows = df.where(F.col(code).isin(*LOGONS)).select(domain.alias("domain"), account.alias("account"), outcome.alias("outcome"), tx.logon_type(F.col(kind)).alias("logon_type"), F.col(host).alias("host"))
    return rows.groupBy("domain", "account", "outcome", "logon_type", "host").agg(F.count("*").alias("n"))


def account_logons(summary: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_id, outcome, logon_type, host, n): a summary's rows for each of ``accounts`` (account_id, name, domain), names in whatever ASCII case.

    An account without domain is meant by its name in any domain. The summary is added up for each name, with
    its domain and in any, before accounts meet it; so only ids of several rows are added up behind the join.
    """
    own = tx.ascii_lower(F.col("domain"))
    meant = summary.where("account IS NOT NULL").select(tx.ascii_lower(F.col("account")).alias("_name"), F.explode(F.array_distinct(F.array(own, F.lit(None).cast("string")))).alias("_domain"), "outcome", "logon_type", "host", "n")
    meant = sized(checkpointed(meant.groupBy("_name", "_domain", "outcome", "logon_type", "host").agg(F.sum("n").alias("n"))))
    # Dealt by id into a fixed number of parts, as a few rows of accounts give very many.
    parts = int(accounts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = accounts.select("account_id", tx.ascii_lower(F.col("name")).alias("_of"), tx.ascii_lower(F.col("domain")).alias("_in")).repartition(parts, "account_id")
    wanted = wanted.withColumn("_rows", F.count("*").over(W.partitionBy("account_id")))
    joined = wanted.join(meant, (F.col("_of") == F.col("_name")) & F.col("_in").eqNullSafe(F.col("_domain")))
    columns = ["account_id", "outcome", "logon_type", "host"]
    several = joined.where("_rows > 1").groupBy(*columns).agg(F.sum("n").alias("n"))
    return joined.where("_rows = 1").select(*columns, "n").unionByName(several)


def typed_urls(values: DataFrame, times: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Typed links with their time (microseconds), where there is one; a time that was never set is none."""
    return values.join(times, keys, "left").withColumn(at, F.nullif(F.col(at), F.lit(UNSET)))


def with_values(rows: DataFrame, values: DataFrame, key: str, name: str, value: str, wanted: dict[str, str]) -> DataFrame:
    """``rows`` with columns from key/value rows: for each name in ``wanted`` its value (of several the greatest), under the column that it gives."""
    wide = values.where(F.col(name).isin(*wanted)).groupBy(key).agg(*[F.max(F.when(F.col(name) == which, F.col(value))).alias(column) for which, column in wanted.items()])
    return rows.join(wide, key, "left")


def merged_annotations(rows: DataFrame, place: str, kind: str, content: str, order: str, destination: str, metadata: str, first: list[str]) -> DataFrame:
    """One row for each place: its last destination and metadata by ``order``, the first non-blank of each of ``first``, and whether it has no destination (``orphan``)."""

    def last(which: str) -> Column:
        return F.max_by(F.col(content), F.when(F.col(kind) == which, F.col(order)))

    earliest = [F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in first]
    found = rows.where(F.col(place).isNotNull()).groupBy(place).agg(last(destination).alias("destination"), last(metadata).alias("metadata"), F.max(F.col(kind) == destination).alias("_has"), *earliest)
    return found.withColumn("orphan", ~F.coalesce("_has", F.lit(False))).drop("_has")


def marks_list(marks: DataFrame, active: DataFrame, order: str, actor: str | None = None) -> DataFrame:
    """``marks`` (row_id, actor, ...) in the order of ``order``, optionally of one actor; ``inactive`` flags rows that no loaded run holds."""
    own = marks if actor is None else marks.where(F.col("actor") == actor)
    there = active.select("row_id").distinct().withColumn("_there", F.lit(True))
    return own.join(there, "row_id", "left").withColumn("inactive", F.col("_there").isNull()).drop("_there").orderBy(order, "row_id")


# Kinds of links in their order; characters of a filter; entries of one page.
LINK_KINDS = ["host", "account", "ioc"]
MAX_FILTER, MAX_ENTRIES = 1000, 1000
LINKS = "entry_id long, kind string, id long, label string, linked_at timestamp, deleted boolean"


def link_rows(links: dict[str, DataFrame], records: dict[str, DataFrame]) -> DataFrame:
    """Rows of ``LINKS`` of each kind's links (entry_id, record_id, linked_at) and records (id, deleted, and name; domain and name; or type and value)."""
    shown = {
        "host": lambda: F.col("name"),
        "account": lambda: F.concat(F.coalesce(F.concat("domain", F.lit("\\")), F.lit("")), "name"),
        "ioc": lambda: F.concat_ws(" ", "type", "value"),
    }
    parts = []
    for kind in LINK_KINDS:
        if kind in links:
            named = records[kind].select(F.col("id").cast("long").alias("id"), shown[kind]().alias("label"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
            held = links[kind].select(F.col("entry_id").cast("long").alias("entry_id"), F.col("record_id").cast("long").alias("id"), F.col("linked_at").cast("timestamp").alias("linked_at"))
            parts.append(held.join(named, "id").select("entry_id", F.lit(kind).alias("kind"), "id", "label", "linked_at", "deleted"))
    return reduce(DataFrame.unionByName, parts)


def entry_list(entries: DataFrame, evidence: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``entries`` (entry_id, ...) with the number of their evidence rows, their hosts and, with ``links``, all their links.

    Without ``links``, hosts are those of the evidence (entry_id, host). With rows of ``LINKS``, they are the names of the
    linked hosts that live, and ``links`` is a list of (kind, id, label): hosts, accounts, indicators, each as linked, then by id.
    One aggregate each for evidence and links.
    """
    text = lambda c: F.array_join(F.array_sort(c), ", ")
    if links is None:
        of_entry = evidence.groupBy("entry_id").agg(F.count("*").alias("evidence"), text(F.collect_set("host")).alias("hosts"))
        return entries.join(of_entry, "entry_id", "left").withColumns({"evidence": F.coalesce("evidence", F.lit(0)), "hosts": F.coalesce("hosts", F.lit(""))})
    counted = evidence.groupBy("entry_id").agg(F.count("*").alias("evidence"))
    place = F.array_position(F.array(*[F.lit(k) for k in LINK_KINDS]), F.col("kind"))
    live = links.where("NOT deleted").withColumn("link", F.struct(place.alias("place"), "linked_at", "id", "kind", "label"))
    listed = F.transform(F.array_sort(F.collect_list("link")), lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"), x["label"].alias("label")))
    linked = live.groupBy("entry_id").agg(listed.alias("links"), text(F.collect_set(F.when(F.col("kind") == "host", F.col("label")))).alias("hosts"))
    none = F.array().cast("array<struct<kind:string,id:bigint,label:string>>")
    out = entries.join(counted, "entry_id", "left").join(linked, "entry_id", "left")
    return out.withColumns({"evidence": F.coalesce("evidence", F.lit(0)), "hosts": F.coalesce("hosts", F.lit("")), "links": F.coalesce("links", none)})


@dataclass(frozen=True)
class EntryQuery:
    """What entries are asked for; all of it must hold. ``text`` is in the title or the description; case aside, as for ``host``."""

    status: tuple[str, ...] = ()
    host: str | None = None
    tactic: str | None = None
    text: str | None = None
    row: int | None = None


def pick_entries(entries: DataFrame, asked: EntryQuery, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """The live entries (entry_id, deleted, status, tactic, title, description) that ``asked`` selects; host and row as semi joins."""
    for what, value in (("text", asked.text), ("host", asked.host)):
        if value is not None and len(value) > MAX_FILTER:
            raise ValueError(f"a {what} of at most {MAX_FILTER} characters")
    out = entries.where("NOT deleted")
    if asked.status:
        out = out.where(F.col("status").isin(list(asked.status)))
    if asked.tactic is not None:
        out = out.where(F.col("tactic") == asked.tactic)
    if asked.text is not None:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(asked.text)))
        out = out.where(has("title") | has("description"))
    if asked.host is not None:
        of_host = links.where((F.col("kind") == "host") & ~F.col("deleted") & (F.lower("label") == F.lower(F.lit(asked.host)))).select("entry_id")
        out = out.join(of_host, "entry_id", "left_semi")
    if asked.row is not None:
        out = out.join(evidence.where(F.col("row_id") == asked.row).select("entry_id"), "entry_id", "left_semi")
    return out


def entry_page(entries: DataFrame, asked: EntryQuery, evidence: DataFrame, links: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of ``pick_entries`` by time (undated last), then id, with ``position`` and ``truncated``; counts and lists are made for its entries alone."""
    if not 0 < limit <= MAX_ENTRIES or offset < 0:
        raise ValueError(f"1 to {MAX_ENTRIES} entries, from 0 on")
    order = [F.col("time").asc_nulls_last(), F.col("entry_id").asc()]
    some = pick_entries(entries, asked, evidence, links).orderBy(*order).offset(offset).limit(limit + 1)  # at most ``limit`` + 1 rows
    placed = some.withColumns({"position": F.row_number().over(W.orderBy(*order)).cast("long") - 1 + offset, "truncated": F.count("*").over(W.partitionBy()) > limit})
    page = checkpointed(placed.where(F.col("position") < offset + limit))
    ids = F.broadcast(page.select("entry_id"))
    return entry_list(page, evidence.join(ids, "entry_id", "left_semi"), links.join(ids, "entry_id", "left_semi")).orderBy("position")



def listed(df: DataFrame, by: list[str], item: Column, name: str) -> DataFrame:
    """Distinct items of each group, sorted, as one text."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(item)), ", ").alias(name))


def slot_positions(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """(keys..., slot, position) of each binary slot list; a slot that stands twice counts where it stands last."""
    return df.select(*keys, F.posexplode(tx.slots(F.col(raw))).alias("position", "slot")).groupBy(*keys, "slot").agg(F.max("position").cast("long").alias("position"))


def stream_rows(df: DataFrame, name: str, size: str, streams: str) -> DataFrame:
    """A row for each file, and one more, with its own size, for each of its ``streams`` (array of name, size)."""
    base = F.array(F.struct(F.col(name).alias("name"), F.col(size).cast("long").alias("size"), F.lit(False).alias("is_stream")))
    more = F.transform(streams, lambda s: F.struct(F.concat(F.col(name), F.lit(":"), s["name"]).alias("name"), s["size"].cast("long").alias("size"), F.lit(True).alias("is_stream")))
    rows = df.withColumn("_row", F.explode(F.concat(base, F.coalesce(more, F.slice(base, 1, 0)))))
    return rows.drop(name, size, streams).select("*", F.col("_row.name").alias(name), F.col("_row.size").alias(size), F.col("_row.is_stream").alias("is_stream")).drop("_row")
