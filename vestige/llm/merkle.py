"""Merkle manifest of a dataset: built level by level, checked by a recursive climb.

A row is a leaf: the SHA-256 of its columns, each as its length and value. The
leaves of a source, by id, are hashed in runs of ``FANOUT``, those digests
again, until one is left: the source's root. The roots of all sources, by
source, are hashed likewise into the root of the dataset. All built levels are
kept as one table of nodes, a row a node: the digests of its children, and the
key of its parent.

To check rows against a manifest, a recursive query climbs from the leaves. The
leaves of one run go side by side, as all above the run is the same for them:
each step joins the parent by its key, folds the digest of each leaf (as it is
now) into its siblings' digests (as they were stored), and appends the siblings to
the proof. A node with very many runs below it is stored in copies, and every
run asks the copy that its number names, so no join key is hot. Positions
come from one range-partitioned copy of the leaves, so no source lies in one task.

Nulls: a missing value is hashed as ``-``; rows without source are the first
source, rows without id the first of theirs, never changed by ``tampered``. Rows
of one id are ordered by their digest; equal rows are leaves of their own, with
equal results up to their places. An empty text is a value of length 0. Long texts are
hashed whole. Columns beyond the named ones, of any name, are left out. An empty
table has no leaf, no node and no row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.llm.shared import own_columns, partitions, stash
from vestige.operators.lookups import sized

#: Digests that are hashed together, the columns of a leaf in their order, letters that tampering changes.
FANOUT = 16
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that climb through one copy of a node.
RUNS_A_COPY = 4096
#: The tree over the roots of all sources.
TOP = -1


@dataclass(frozen=True)
class Manifest:
    """``runs``: run_id, start of the source, run, n (leaves of the source), members (place, doc_id, leaf, now).

    ``nodes``: tree, level, place, n (nodes beside it on its level), digest,
    children (their digests in one), runs (below it), and up_tree, up_level,
    up_place, slot, up_copies: the parent, the place among its children, and the
    copies of it. ``anchors``: the same of each run, without children.
    """

    runs: DataFrame
    nodes: DataFrame
    anchors: DataFrame


def piece(value: Column) -> Column:
    """What of a value is hashed: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(hexadecimal: Column) -> Column:
    """SHA-256 of a text, as bytes."""
    return F.unhex(F.sha2(hexadecimal, 256))


def shown(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(text: Column | None = None) -> Column:
    return digest(F.concat(*[piece(text if c == "text" and text is not None else F.col(c)) for c in LEAF]))


def tampered() -> Column:
    """The leaf after tampering: the A-Z of the text in lower case where 5 divides the CRC-32 of the id."""
    changed = leaf_digest(F.translate("text", UPPER, LOWER))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed).otherwise(leaf_digest())


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` in their group from 0, ``n`` rows of the group and ``start``, the rows of all groups before.

    Rows are range-partitioned and kept so; a table of a row for each partition and
    group in it brings in what lies in the partitions before.
    """
    low = (1 << 33) - 1  # the lower part of an increasing id counts the rows of a partition
    placed = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    placed = stash(placed.withColumn("nth", F.monotonically_increasing_id()), "ranked")
    placed = placed.select(*rows.columns, F.shiftright("nth", 33).alias("part"), F.col("nth").bitwiseAND(F.lit(low)).alias("nth"))
    edges = placed.groupBy("part", group).agg(F.count("*").alias("here"), F.min("nth").alias("first"))
    sizes = edges.groupBy("part").agg(F.sum("here").alias("size"))  # as many rows as partitions
    bases = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    of_group = W.partitionBy(group)
    edges = edges.join(F.broadcast(bases), "part").select(
        F.col("part").alias("edge_part"),
        F.col(group).alias("edge_group"),
        "first",
        F.coalesce(F.sum("here").over(of_group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("here").over(of_group).alias("n"),
        F.min(F.col("base") + F.col("first")).over(of_group).alias("start"),
    )
    same = (F.col("part") == F.col("edge_part")) & F.col(group).eqNullSafe(F.col("edge_group"))
    return placed.join(sized(stash(edges, "ranks")), same).select(*rows.columns, "start", "n", (F.col("nth") - F.col("first") + F.col("before")).alias("place"))


def fewer(n: Column) -> Column:
    """How many runs ``n`` nodes make."""
    return F.ceil(n / FANOUT).cast("long")


def run_of(place: Column) -> Column:
    return F.floor(place / FANOUT).cast("long")


def joined(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def levels_above(nodes: DataFrame, level: int) -> list[DataFrame]:
    """The levels over ``nodes`` (tree, place, n, digest, runs), until every tree has one node."""
    out = []
    while True:
        grouped = nodes.where("n > 1").groupBy("tree", run_of(F.col("place")).alias("place"), fewer(F.col("n")).alias("n"))
        parents = grouped.agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("below"), F.sum("runs").alias("runs"))
        parents = parents.withColumn("children", joined(F.transform("below", lambda c: c["digest"])))
        level += 1
        nodes = stash(parents.select("tree", F.lit(level).alias("level"), "place", "n", digest(shown(F.col("children"))).alias("digest"), "children", "runs"), "merkle-level")
        if nodes.isEmpty():
            return out
        out.append(nodes)


KEY = ("tree", "level", "place")


def build(docs: DataFrame, now: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``now``: each leaf as it is when checked, in place of its digest."""
    own = own_columns(docs, *LEAF)
    leaves = stash(own.select("doc_id", "source", leaf_digest().alias("leaf"), (leaf_digest() if now is None else now).alias("now")), "leaves")
    placed = ranked(leaves, "source", ["doc_id", "leaf"])
    members = F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "now"))).alias("members")
    runs = placed.groupBy("start", "n", run_of(F.col("place")).alias("run")).agg(members)
    runs = stash(runs.withColumn("run_id", F.col("start") + F.col("run")), "merkle-runs")

    lone = F.col("n") == 1  # a lone leaf is its source's root
    first = runs.withColumn("children", joined(F.transform("members", lambda m: m["leaf"]))).select(
        F.col("start").alias("tree"),
        F.when(lone, 0).otherwise(1).alias("level"),
        F.col("run").alias("place"),
        fewer(F.col("n")).alias("n"),
        F.when(lone, F.col("children")).otherwise(digest(shown(F.col("children")))).alias("digest"),
        F.lit(1).cast("long").alias("runs"),
        "run_id",
    )
    first = stash(first, "merkle-level")
    inner = levels_above(first, 1)
    nodes = first.drop("run_id").withColumn("children", F.lit(None).cast("binary"))
    for level in inner:
        nodes = nodes.unionByName(level)
    roots = nodes.where("n = 1").select("tree", "digest", "runs", F.lit(0).alias("one"))
    placed_roots = stash(ranked(roots, "one", ["tree"]).select("tree", "digest", "runs", "place", "n"), "merkle-roots")
    over = levels_above(placed_roots.select(F.lit(TOP).cast("long").alias("tree"), "place", "n", "digest", "runs"), 0)
    for level in over:
        nodes = nodes.unionByName(level)

    # Parents by arithmetic; a source's root hangs in the tree over all of them.
    inside = nodes.where("n > 1").select("*", F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), run_of(F.col("place")).alias("up_place"), (F.col("place") % FANOUT).alias("slot"))
    of_root = placed_roots.select("tree", F.col("place").alias("root_place"), F.col("n").alias("roots"))
    hung = nodes.where(f"n = 1 AND tree <> {TOP}").join(of_root, "tree").select(
        *nodes.columns,
        F.when(F.col("roots") > 1, TOP).cast("long").alias("up_tree"),
        F.when(F.col("roots") > 1, 1).alias("up_level"),
        F.when(F.col("roots") > 1, run_of(F.col("root_place"))).alias("up_place"),
        F.when(F.col("roots") > 1, F.col("root_place") % FANOUT).alias("slot"),
    )
    none = F.lit(None).cast("long")
    root = nodes.where(f"n = 1 AND tree = {TOP}").select("*", none.alias("up_tree"), none.cast("int").alias("up_level"), none.alias("up_place"), none.alias("slot"))
    copies = nodes.where("children IS NOT NULL").select(*[F.col(c).alias(f"up_{c}") for c in KEY], F.ceil(F.col("runs") / RUNS_A_COPY).cast("long").alias("up_copies"))
    linked = stash(inside.unionByName(hung).unionByName(root).join(copies, [f"up_{c}" for c in KEY], "left"), "merkle-nodes")
    anchors = linked.where("children IS NULL").drop("children").join(first.select(*KEY, "run_id"), list(KEY))
    return Manifest(runs, linked.where("children IS NOT NULL"), anchors)


def without(children: str, slot: str) -> str:
    """SQL: the digests beside the one at ``slot``."""
    return f"concat(substring({children}, 1, cast(32 * {slot} AS int)), substring({children}, cast(32 * {slot} + 33 AS int)))"


def folded(children: str, slot: str, mine: str) -> str:
    """SQL: the digest of ``children`` with ``mine`` at ``slot``."""
    around = f"concat(substring({children}, 1, cast(32 * {slot} AS int)), {mine}, substring({children}, cast(32 * {slot} + 33 AS int)))"
    return f"unhex(sha2(lower(hex({around})), 256))"


CLIMB = """
WITH RECURSIVE climb(run_id, tree, own, subroot, folds, above, up_tree, up_level, up_place, slot, up_copies) AS (
  SELECT run_id, tree, digest, digest, folds, above, up_tree, up_level, up_place, slot, up_copies FROM {starts}
  UNION ALL
  SELECT c.run_id, p.tree, p.digest, CASE WHEN p.tree >= 0 THEN p.digest WHEN c.tree >= 0 THEN c.own ELSE c.subroot END,
         transform(c.folds, f -> {folded}), concat(c.above, {siblings}),
         p.up_tree, p.up_level, p.up_place, p.slot, p.up_copies
  FROM climb c JOIN {nodes} p
    ON p.tree = c.up_tree AND p.level = c.up_level AND p.place = c.up_place AND p.copy = pmod(c.run_id, c.up_copies))
SELECT run_id, own AS root, subroot, folds, above FROM climb WHERE up_tree IS NULL
"""


def climb(manifest: Manifest) -> DataFrame:
    """run_id, root, subroot, folds (of every leaf of the run, what its present digest makes of the root), above (the siblings over the run)."""
    spark = manifest.runs.sparkSession
    leaves = manifest.runs.where("n > 1").withColumn("children", joined(F.transform("members", lambda m: m["leaf"])))
    first = leaves.select("run_id", F.expr(f"transform(members, (m, i) -> {folded('children', 'i', 'm.now')})").alias("folds"))
    lone = manifest.runs.where("n = 1").select("run_id", F.transform("members", lambda m: m["now"]).alias("folds"))
    starts = manifest.anchors.join(first.unionByName(lone), "run_id").withColumn("above", F.lit(b""))
    copies = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("runs") / RUNS_A_COPY).cast("long") - 1)
    nodes = manifest.nodes.withColumn("copy", F.explode(copies))
    names = {"starts": f"starts_{uuid.uuid4().hex}", "nodes": f"nodes_{uuid.uuid4().hex}"}
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    starts.createOrReplaceTempView(names["starts"])
    nodes.createOrReplaceTempView(names["nodes"])
    try:
        spark.conf.set(limit, "-1")
        sql = CLIMB.format(**names, folded=folded("p.children", "c.slot", "f"), siblings=without("p.children", "c.slot"))
        return stash(spark.sql(sql), "merkle-climb")
    finally:
        spark.conf.set(limit, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


def verify(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf."""
    beside = F.expr(without("children", "at"))
    rows = manifest.runs.select("run_id", "n", joined(F.transform("members", lambda m: m["leaf"])).alias("children"), F.posexplode("members").alias("at", "member"))
    rows = rows.select("run_id", "at", "member.doc_id", "member.leaf", F.when(F.col("n") == 1, F.lit(b"")).otherwise(beside).alias("beside"))
    met = rows.join(climb(manifest), "run_id").withColumn("folded", F.get("folds", "at"))
    return met.select(
        "doc_id",
        *[shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(shown(F.concat("beside", "above")), 256).alias("proof_sha256"),
        shown(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def check_tampered(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, and each row of them held against it after ``tampered``."""
    return verify(build(docs, tampered()))
