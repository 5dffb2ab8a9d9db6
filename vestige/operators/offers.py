"""What rows offer for the record: accounts and indicators in the columns that a table of takers names, over many relations at once."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.functions import indicators as ind
from vestige.operators.lookups import sized
from vestige.operators.search import ascii_fold
from vestige.relation import Relation

#: Fixed value: what a logon's target is written with.
TARGET = "Target: "
OFFER = "struct<column:string,kind:string,ioc_type:string,value:string,domain:string,sid:string>"


@dataclass(frozen=True)
class Taker:
    """Which relations (``*`` for one character or more, or at the end for any), which column, and what it is read as.

    ``take``: ``account``, ``logon_target``, ``address`` (an address, or a name with one in round brackets), or a kind of indicator.
    ``sid``: the column of the account's identifier.
    """

    relations: str
    column: str
    take: str
    sid: str | None = None

    def fits(self, name: str) -> bool:
        inside, last = self.relations.removesuffix("*"), ".*" if self.relations.endswith("*") else ""
        return re.fullmatch(".+".join(map(re.escape, inside.split("*"))) + last, name, re.S) is not None


def _offer(column: str, kind: str, ioc_type: str | None, value: Column, domain: Column | None = None, sid: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = {"column": F.lit(column), "kind": F.lit(kind), "ioc_type": F.lit(ioc_type).cast("string"), "value": value, "domain": none if domain is None else domain, "sid": none if sid is None else sid}
    return F.when(value.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))


def _read(taker: Taker, relation: Relation) -> dict[str, Column]:
    """What a taker reads in a row, each of it computed once before offers are made of it."""
    cell = relation.text_of(taker.column)
    if taker.take in ("account", "logon_target"):
        text = cell if taker.take == "account" else F.when(cell.startswith(TARGET), F.substring(cell, len(TARGET) + 1, 1 << 30))
        sid = {"sid": ind.sid(relation.text_of(taker.sid))} if taker.sid and taker.sid in relation.df.columns else {}
        return {"account": ind.account(text), **sid}
    if taker.take == "address":
        inside = F.regexp_extract(cell, r"^(?s:.*) \(((?s:.*))\)\z", 1)  # behind the last opening bracket
        return {"value": F.coalesce(ind.indicator("ip", cell), F.when(inside != "", ind.indicator("ip", inside)))}
    return {"value": ind.indicator(taker.take, cell)}


def _taken(taker: Taker, read: dict[str, Column]) -> Column:
    if taker.take in ("account", "logon_target"):
        return _offer(taker.column, "account", None, read["account"]["name"], read["account"]["domain"], read.get("sid"))
    return _offer(taker.column, "ioc", "ip" if taker.take == "address" else taker.take, read["value"])


def _same(x: Column, y: Column) -> Column:
    folded = [ascii_fold(x[c]).eqNullSafe(ascii_fold(y[c])) for c in ("value", "domain")]
    return (x["kind"] == y["kind"]) & x["ioc_type"].eqNullSafe(y["ioc_type"]) & folded[0] & folded[1]


def offers(relation: Relation, takers: list[Taker], path_column: str | None = None) -> DataFrame:
    """relation, row_id, nth and the offer, a row each; of equal offers of a row (ASCII case aside) the first column's. No shuffle."""
    fitting = [t for t in takers if t.fits(relation.name) and t.column in relation.df.columns]
    if path_column:
        fitting.append(Taker("*", path_column, "file_path"))
    cells = [_read(t, relation) for t in fitting]
    read = relation.df.select(F.lit(relation.name).alias("relation"), F.col(relation.row_id).cast("long").alias("row_id"), *[c.alias(f"_{i}_{part}") for i, parts in enumerate(cells) for part, c in parts.items()])
    found = [_taken(t, {part: F.col(f"_{i}_{part}") for part in cells[i]}) for i, t in enumerate(fitting)]
    rows = read.select("relation", "row_id", F.array_compact(F.array(*[f.cast(OFFER) for f in found]).cast(f"array<{OFFER}>")).alias("all"))
    first = F.filter("all", lambda x, i: ~F.exists(F.slice("all", F.lit(1), i), lambda y: _same(x, y)))
    first = F.when(F.size("all") < 2, F.col("all")).otherwise(first)
    return rows.select("relation", "row_id", F.posexplode(first).alias("nth", "o")).select("relation", "row_id", "nth", "o.*")


def candidates(relations: list[tuple[Relation, str | None]], takers: list[Taker], accounts: DataFrame | None = None, iocs: DataFrame | None = None) -> DataFrame:
    """The offers of all rows of (relation, column of the evidence path), with ``existing_id``.

    ``accounts`` (id, name, domain) and ``iocs`` (id, type, value) are the records that live. An
    account is the one with its name and domain, else that with its name and no domain; ASCII
    case aside, of several the least id. Offers without a record have null.
    """
    found = reduce(DataFrame.unionByName, [offers(r, takers, path) for r, path in relations])
    found = found.withColumns({"_value": ascii_fold(F.col("value")), "_domain": ascii_fold(F.col("domain"))})
    none = F.lit(None).cast("long")
    if accounts is None:
        found = found.withColumns({"_own": none, "_bare": none})
    else:
        known = accounts.groupBy(ascii_fold(F.col("name")).alias("_name"), ascii_fold(F.nullif("domain", F.lit(""))).alias("_of")).agg(F.min("id").cast("long").alias("_id"))
        known = known.where("_name IS NOT NULL")
        own = sized(known.select("_name", F.col("_of").alias("_own_domain"), F.col("_id").alias("_own")))
        bare = sized(known.where("_of IS NULL").select(F.col("_name").alias("_bare_name"), F.col("_id").alias("_bare")))
        is_account = F.col("kind") == "account"
        found = found.join(own, is_account & (F.col("_value") == F.col("_name")) & F.col("_domain").eqNullSafe(F.col("_own_domain")), "left")
        found = found.join(bare, is_account & (F.col("_value") == F.col("_bare_name")), "left")
    if iocs is None:
        found = found.withColumn("_ioc", none)
    else:
        known = iocs.groupBy(F.col("type").alias("_type"), ascii_fold(F.col("value")).alias("_text")).agg(F.min("id").cast("long").alias("_ioc"))
        found = found.join(sized(known), (F.col("ioc_type") == F.col("_type")) & (F.col("_value") == F.col("_text")), "left")
    return found.select("relation", "row_id", F.col("nth").cast("long").alias("nth"), "kind", "ioc_type", "value", "domain", "sid", "column", F.coalesce("_own", "_bare", "_ioc").alias("existing_id"))
