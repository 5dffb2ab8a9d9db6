"""Near-duplicate documents by ProbMinHash.

Shingles of five words are weighted by how often they occur. Each sends
arrivals, a Poisson process whose rate is its weight, to the registers of a
signature at random; a register keeps the shingle that came first. A shingle
stops as soon as its next arrival is later than the last register's, so a long
text costs little more than one arrival a shingle. Two texts agree in a
register with the probability Jaccard likeness of their weighted shingles. A
text that repeats shingles has a second signature, with weight 1 for each, so
that texts also meet with their plain Jaccard likeness; of a text that repeats
none both are the same.

Texts of one weighted shingle set (exact copies above all) are one *profile*,
known by its least id, its *node*. Bands of registers are joined in Spark, and
what shares a bucket is compared on whole texts:

1. Each bucket has a centre, the node that shares most buckets with most others.
   Every node of the bucket is compared with it. That settles nearly all of a group.
2. Of the nodes of a centre that are of different classes then, all pairs are counted: what each two share comes
   from products of matrices over their shingles, in blocks of two pieces of ``PIECE`` nodes
   that are dealt out (``counted_pairs``). Only pairs that are links, or may be by their repeats, leave a
   block, of the sure ones as many as join their classes. They are verified like the first.

No pair of a bucket is left out that could be a link, and no row is made for one that is none: a group of
texts just too unlike costs products of its size squared, but its texts are read once for each piece.
Classes are connected components, found by label propagation in Spark.

Likeness of two texts is the greater of probability Jaccard (counts) and plain
Jaccard (sets). Texts of fewer than five words are one shingle; texts without
words (nulls) are alike to none, their own class. Rows without id get the class
of their profile, null if no row with an id has it. Repeated rows are one
profile; rows of one id but different texts are one class. With other columns
of any name nothing changes. An empty table gives no rows. Long texts are
compared alone, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.llm.shared import drop_stashes, map_batches, own_columns, partitions, stash, stashes, whole_text
from vestige.llm.shingles import distinct_shingles, groups, spread

REGISTERS = 192
BAND = 6
#: Partners of one node that are verified in one piece, and members of a centre that are counted in one.
PIECE = 500
#: Shingles of a piece that is counted, and columns of the matrices that are multiplied at once.
PIECE_SHINGLES, COLUMNS = 500_000, 2048
#: Nodes of buckets up to which their ids are broadcast to fetch their texts (8 bytes each); more are joined by shuffle.
MOST_NODES = 1_000_000
#: Pairs up to which they are broadcast to the texts (24 bytes each); more are joined by shuffle.
MOST_BROADCAST = 250_000
#: Bytes of partners' texts that are taken apart at once.
BLOCK = 1 << 20


def arrivals(shingles: np.ndarray, count: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Waits (for rate 1) and registers of each shingle's arrivals number ``first`` and on."""
    number = np.arange(first + 1, first + 1 + count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = spread(shingles[:, None] * np.uint64(0x9E3779B97F4A7C15) + number * np.uint64(0xC2B2AE3D27D4EB4F))
        y = spread(x + np.uint64(0x165667B19E3779F9))
    waits = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)
    return waits, ((y >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)


def signatures(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """For each text the shingle of the first arrival in every register (0 for texts without shingles)."""
    first = np.full((texts, REGISTERS), np.inf)
    holder = np.zeros((texts, REGISTERS), np.uint64)
    active, clock, number = np.arange(len(shingles)), np.zeros(len(shingles)), 0
    rate = weights.astype(np.float64)
    while len(active):
        block = int(min(64, max(1, 40_000 // len(active))))
        waits, register = arrivals(shingles[active], block, number)
        number += block
        times = clock[active, None] + np.cumsum(waits / rate[active, None], axis=1)
        clock[active] = times[:, -1]
        latest = first.max(axis=1)
        near = times < latest[owner[active], None]
        rows, columns = np.nonzero(near)
        place = owner[active][rows] * REGISTERS + register[rows, columns]
        when = times[rows, columns]
        np.minimum.at(first.reshape(-1), place, when)
        won = first.reshape(-1)[place] == when
        holder.reshape(-1)[place[won]] = shingles[active[rows[won]]]
        active = active[clock[active] < first.max(axis=1)[owner[active]]]
    return holder


def band_keys(holder: np.ndarray, band: int = BAND) -> np.ndarray:
    """A key for each band (32 at most) and text: 59 bits of a hash of the band's registers, and the band's number."""
    bands = holder.shape[1] // band
    with np.errstate(over="ignore"):
        salt = spread(np.arange(1, holder.shape[1] + 1, dtype=np.uint64))
        terms = spread(holder ^ salt)
        one = spread(terms.reshape(len(holder), bands, band).sum(axis=2, dtype=np.uint64))
        return (one & ~np.uint64(31) | np.arange(bands, dtype=np.uint64)).view(np.int64)


PROFILES = "doc_id long, p1 long, p2 long, n_shingles long, bands binary"


def profiles(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, profile (two longs), distinct shingles and band keys of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for group in groups((t.encode() for t in batch.column(1).to_pylist()), 1 << 20):
                owner, shingles, counts = distinct_shingles(group, size)
                keys = list(band_keys(signatures(owner, shingles, counts, len(group))))
                edges = np.searchsorted(owner, np.arange(len(group) + 1))
                repeating = np.unique(owner[counts > 1])
                if len(repeating):
                    part = np.isin(owner, repeating)
                    plain = band_keys(signatures(np.searchsorted(repeating, owner[part]), shingles[part], np.ones(part.sum(), np.int64), len(repeating)))
                    for i, more in zip(repeating, plain):
                        keys[i] = np.r_[keys[i], more]
                both = np.stack([shingles, counts.astype(np.uint64)], axis=1)
                digests = np.frombuffer(b"".join(hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges, edges[1:])), "<i8").reshape(-1, 2)
                some = np.diff(edges) > 0
                columns = [
                    ids.slice(at, len(group)),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.array(np.diff(edges)),
                    pa.array([k.tobytes() if s else None for k, s in zip(keys, some)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p1", "p2", "n_shingles", "bands"])
                at += len(group)

    return map_batches(own_columns(docs, "doc_id", "text").withColumn("text", whole_text()), work, PROFILES)


def banded(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each distinct band of each profile."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(k, "<i8") for k in batch.column(1).to_pylist()]
            if held:
                keys = [np.unique(k) for k in held]
                owners = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(owners)], names=["key", "node"])

    return map_batches(nodes.select("node", "bands"), work, "key long, node long")


# Comparison on whole texts ---------------------------------------------------


class Comparison:
    """One weighted set against each of ``texts`` others: what they share, and both likenesses."""

    def __init__(self, one: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int):
        shingles, counts = one
        owner, theirs, n = others
        self.owner, self.theirs = owner, theirs
        if len(shingles):
            at = np.minimum(np.searchsorted(shingles, theirs), len(shingles) - 1)
            self.in_common = shingles[at] == theirs
        else:
            at, self.in_common = np.zeros(len(theirs), int), np.zeros(len(theirs), bool)
        self.kinds = np.bincount(owner, minlength=texts)
        self.total = np.bincount(owner, n, minlength=texts).astype(np.int64)
        self.common = np.bincount(owner[self.in_common], minlength=texts)
        self.mass = np.bincount(owner[self.in_common], n[self.in_common], minlength=texts).astype(np.int64)
        self.plain = self.common / np.maximum(len(shingles) + self.kinds - self.common, 1)
        # Where neither repeats a shingle both likenesses are the same.
        self.chance = self.plain.copy()
        repeats = len(counts) and counts.max() > 1
        edges = np.searchsorted(owner, np.arange(texts + 1))
        for i in np.flatnonzero((self.common > 0) & (repeats | (self.total > self.kinds))):
            part = slice(edges[i], edges[i + 1])
            shared = self.in_common[part]
            self.chance[i] = probability_jaccard(counts[at[part]][shared].astype(float), n[part][shared].astype(float), counts.sum(), self.total[i])


def probability_jaccard(x: np.ndarray, y: np.ndarray, x_total: float, y_total: float) -> float:
    """Of two weighted sets whose common elements weigh ``x`` and ``y``: the sum of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    r = y / x  # with r sorted, the inner sum splits at r_i
    order = np.argsort(r, kind="stable")
    x_up, y_up = np.r_[0, np.cumsum(x[order])], np.r_[0, np.cumsum(y[order])]
    split = np.searchsorted(r[order], r, side="right")
    sums = (x_up[split] + x_total - x_up[-1]) / x + (y_up[-1] - y_up[split] + y_total - y_up[-1]) / y
    return float((1 / sums).sum())


MEASURED = "a long, b long, jaccard double, probability_jaccard double, n long"


def measured(pairs: DataFrame, texts: DataFrame, size: int = 5) -> DataFrame:
    """Each pair of ids compared on whole texts; ``n``: distinct shingles of b.

    An id with several texts has a row for each. An id with many
    partners is dealt out in pieces; its own text goes to each piece, its
    partners' texts to one.
    """
    pairs = stash(pairs.select("a", "b"), "pairs")
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIECE).alias("pieces")).where("pieces > 1")
    dealt = stash(pairs.join(heavy, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).alias("piece"), "b"), "dealt")
    wanted = dealt.select("a", "piece", "b", F.col("b").alias("doc_id")).unionByName(dealt.select("a", "piece", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id")).distinct())
    if dealt.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    streams = texts.join(wanted, "doc_id").select("a", "piece", "b", "text").repartition(partitions(texts.sparkSession), "a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first(), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, last = None, [], None
        for batch in batches:
            a_ids, piece, b_ids, text = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(a_ids):
                if (a_ids[at], piece[at]) != group:
                    group, heads, last = (a_ids[at], piece[at]), [], None
                if b_ids[at] is None:
                    if text[at] != last:
                        last = text[at]
                        heads.append(distinct_shingles([last.encode()], size)[1:])
                    at += 1
                    continue
                end, held = at, 0
                while end < len(a_ids) and end - at < 256 and (end == at or held + len(text[end]) <= BLOCK) and b_ids[end] is not None and (a_ids[end], piece[end]) == group:
                    held += len(text[end])
                    end += 1
                others = distinct_shingles([t.encode() for t in text[at:end]], size)
                for one in heads:
                    x = Comparison(one, others, end - at)
                    columns = [pa.array([group[0]] * (end - at), pa.int64()), pa.array(b_ids[at:end], pa.int64()), pa.array(x.plain, pa.float64()), pa.array(x.chance, pa.float64()), pa.array(x.kinds, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MEASURED.split(", ")])
                at = end

    return map_batches(streams, work, MEASURED)


def verify_pairs(pairs: DataFrame, texts: DataFrame, size: int = 5) -> DataFrame:
    """(a, b, jaccard, probability_jaccard) of each pair of ids, on whole texts."""
    return measured(pairs, texts, size).select("a", "b", "jaccard", "probability_jaccard")


# Classes ---------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node is linked with, however far. Label propagation with shortcuts."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stash(both, "links")
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        reached = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("reached"))
        nearer = labels.join(reached.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "reached").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stash(nearer.join(of_label, "label", "left").select("node", "was", F.coalesce(F.least("label", "next"), "label").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label != was").isEmpty():
            return labels


def labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the label of the node in column ``node``; a node without links is its own label."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias(name))
    return rows.join(named, node, "left").withColumn(name, F.coalesce(name, node))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: components of the classes that these join, then each node's."""
    between = labelled(labelled(links.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la != lb")
    fresh = stash(between.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("la").alias("a"), F.col("lb").alias("b")), "between")
    if fresh.isEmpty():
        return labels
    of_class = components(fresh)
    ends = fresh.select(F.col("x").alias("node")).union(fresh.select("y")).distinct()
    nodes = labels.select("node").union(ends).distinct()
    now = labelled(nodes, labels, "node", "was")
    return stash(labelled(now, of_class, "was", "label").select("node", "label"), "labels")


def starred(live: DataFrame, score: DataFrame) -> DataFrame:
    """(a, b): every node of a bucket with the bucket's centre, the node of the greatest score, of several the least."""
    best = live.join(score, "node").groupBy("key").agg(F.max_by("node", F.struct("score", F.bitwise_not("node"))).alias("a"))
    return live.join(best, "key").where("a != node").select("a", F.col("node").alias("b")).distinct()


def shared_lists(members: DataFrame) -> DataFrame:
    """A row for each shingle that a member has and its centre lacks, where members of several classes share it.

    ``key`` names the list, ``length`` its rows; ``most``: whether more than
    half of the centre's members are in it. The classes are found without it since ``counted_pairs``.
    """
    rows = members.select("a", "head", "b", "n", "total", "common", "label", F.explode("added").alias("z")).withColumn("key", F.xxhash64("a", "head", "z")).drop("z")
    sizes = members.groupBy("a", "head").agg(F.count("*").alias("size"))
    lists = rows.groupBy("key", "a", "head").agg(F.count("*").alias("length"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    lists = lists.join(sizes, ["a", "head"]).select("key", "length", ((F.col("length") > 2) & (2 * F.col("length") > F.col("size"))).alias("most"))
    return rows.join(lists, "key")


def telling(lists: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``lists`` by which members that may be alike surely meet, without those that count as the centre's.

    Of a likeness of ``threshold`` the partner has that share of a text's mass, so all but ``(1 - threshold) * total`` of
    its ``n`` shingles at least; ``need`` of these the centre lacks. Who shares ``need`` of a member's lists
    shares one of those left if ``need - 1`` go; in one order for all, the longest go.
    """
    more = F.count(F.when(F.col("most"), 1)).over(W.partitionBy("a", "head", "b"))
    need = F.col("n") - (1 - threshold) * F.col("total") - F.col("common") - F.col("more") - 1e-6
    longest = W.partitionBy("a", "head", "b", "n", "total", "common").orderBy(F.desc("length"), F.desc("key"))
    return lists.withColumn("more", more).where("NOT most").withColumn("nth", F.row_number().over(longest)).where(F.col("nth") >= need).drop("more", "nth")


def in_common(owner: np.ndarray, shingles: np.ndarray, rows: np.ndarray, columns: np.ndarray, texts: int) -> np.ndarray:
    """How many shingles each text of ``rows`` shares with each of ``columns``; ``shingles`` are distinct within their ``owner``."""
    order = np.argsort(shingles, kind="stable")
    ordered, of = shingles[order], owner[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    kind = np.cumsum(new) - 1
    several = np.bincount(kind)[kind] > 1 if len(kind) else new
    kind, of = np.unique(kind[several], return_inverse=True)[1], of[several]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for first in range(0, int(kind.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(kind, [first, first + COLUMNS])
        held = np.zeros((texts, COLUMNS), np.float32)
        held[of[a:b], kind[a:b] - first] = 1
        out += held[rows] @ held[columns].T
    return out


def apart_within(owner: np.ndarray, shingles: np.ndarray, counts: np.ndarray, slot: np.ndarray, label: np.ndarray, stranger: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (rows of two places) of texts of different labels that are links, or may be by repeats.

    Where there are two slots, only pairs across them. ``stranger``: not of the centre's class; one of two is. Of pairs that are links by
    plain likeness, as many as join all their labels.
    """
    texts = len(slot)
    n = np.bincount(owner, minlength=texts)
    total = np.bincount(owner, counts, minlength=texts).astype(np.int64)
    across = slot.min() != slot.max()
    sides = [(stranger & (slot == slot.min()), slot == slot.max()), (~stranger & (slot == slot.min()), stranger & (slot == slot.max()))] if across else [(stranger, np.ones(texts, bool))]
    sure, open_ = [], []
    for left, right in sides:
        rows, columns = np.flatnonzero(left), np.flatnonzero(right)
        if not len(rows) or not len(columns):
            continue
        s = in_common(owner, shingles, rows, columns, texts).astype(np.float64)
        apart = (label[rows][:, None] != label[columns]) & (s > 0)
        plain = apart & (s / np.maximum(n[rows][:, None] + n[columns] - s, 1) >= threshold)
        sure.append(np.stack([rows[(at := np.nonzero(plain))[0]], columns[at[1]]], axis=1))
        if (total > n).any():
            inverse = [total[t] / np.maximum(np.minimum(total[t], s_t + total[t] - n[t]), 1) for t, s_t in ((rows, s.T), (columns, s))]
            may = apart & ~plain & ((total > n)[rows][:, None] | (total > n)[columns]) & (inverse[0].T + inverse[1] <= 1 + 1 / threshold + 1e-9)
            open_.append(np.stack([rows[(at := np.nonzero(may))[0]], columns[at[1]]], axis=1))
    found = np.concatenate(sure) if sure else np.zeros((0, 2), np.int64)
    between = np.unique(np.sort(label[found], axis=1), axis=0, return_index=True)[1]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for pair in found[between]:
        x, y = (top(int(v)) for v in label[pair])
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(pair)
    kept += [pair for pair in (np.concatenate(open_) if open_ else ()) if top(int(label[pair[0]])) != top(int(label[pair[1]]))]
    return np.array(kept, np.int64).reshape(-1, 2)


def counted_pairs(members: DataFrame, texts: DataFrame, threshold: float, size: int = 5) -> DataFrame:
    """(a, b): members of one centre, of different classes, that are links by plain likeness, or may be by repeats; of the former as many as join their classes.

    Members are dealt out in pieces, each two pieces meet in one group: a text is read once for each piece of its centre.
    """
    spark = texts.sparkSession
    one = members.groupBy("a", "b", "label", "centre_label").agg(F.max("n").alias("n"))
    about = one.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("n") / PIECE_SHINGLES)).cast("int").alias("pieces"))
    slots = one.join(about, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = slots.select("a", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "slot", "b", "label", (F.col("label") != F.col("centre_label")).alias("stranger"))
    group = ("a", "low", "high")
    streams = dealt.join(texts, F.col("b") == F.col("doc_id")).select(*group, "slot", "b", "label", "stranger", "text").repartition(partitions(spark), *group).sortWithinPartitions(*group)

    def found(held: list[tuple]) -> pa.RecordBatch:
        slot, b, label, stranger, text = zip(*held)
        parts, at = [], 0
        for part in groups((t.encode() for t in text), BLOCK):
            owner, shingles, counts = distinct_shingles(part, size)
            parts.append((owner + at, shingles, counts))
            at += len(part)
        ids = np.array(b, np.int64)
        pairs = np.sort(ids[apart_within(*(np.concatenate(x) for x in zip(*parts)), np.array(slot), np.array(label, np.int64), np.array(stranger, bool), threshold)], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if row[:3] != now:
                    if any(h[3] for h in held):
                        yield found(held)
                    now, held = row[:3], []
                held.append(row[3:])
        if any(h[3] for h in held):
            yield found(held)

    return map_batches(streams, work, "a long, b long").distinct()


def same_ids(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of different texts of one id."""
    several = known.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct("p1", "p2")).alias("low"), F.max(F.struct("p1", "p2")).alias("high")).where("low != high").select("doc_id")
    of_id = known.where("n_shingles > 0").join(several, "doc_id").select("doc_id", "p1", "p2").distinct().join(nodes.select("p1", "p2", "node"), ["p1", "p2"])
    return of_id.where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def classes(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, class_id (the class's least id), profile_id, n_shingles of every row of ``docs``."""
    return linked(docs, profiles(docs, size), F.greatest("jaccard", "probability_jaccard") >= threshold, threshold, size)


def linked(docs: DataFrame, profiled: DataFrame, alike: Column, threshold: float, size: int) -> DataFrame:
    """The classes of ``docs``, whose rows have the profiles and bands ``profiled``, by links for which ``alike`` holds.

    ``alike`` must hold where plain Jaccard reaches ``threshold``; elsewhere it may ask for more than that one likeness does, not for less.
    """
    known = stash(profiled, "profiles")
    nodes = stash(known.where("n_shingles > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")).where("node IS NOT NULL"), "nodes")
    rows = banded(nodes)
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = stash(rows.join(buckets, "key"), "buckets")
    score = stash(live.groupBy("node").agg(F.sum(F.col("n") - 1).alias("score")), "score")
    # Only nodes that share a bucket are ever compared: later steps read their texts alone.
    few = score.limit(MOST_NODES + 1).count() <= MOST_NODES
    wanted = score.select(F.col("node").alias("doc_id"))
    texts = own_columns(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = stash(texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), "texts")
    labels = merged(docs.sparkSession.createDataFrame([], "node long, label long"), same_ids(known, nodes))
    members = stash(measured(starred(live, score), texts, size).withColumn("alike", alike), "members")
    labels = merged(labels, members.where("alike"))
    named = labelled(labelled(members.select("a", "b", "n"), labels, "a", "centre_label"), labels, "b", "label")
    mixed = stash(named.join(named.where("label != centre_label").select("a").distinct(), "a", "left_semi"), "mixed")
    if not mixed.isEmpty():
        apart = counted_pairs(mixed, texts, threshold, size)
        labels = merged(labels, stash(verify_pairs(apart, texts, size).where(alike), "verified"))
    named = nodes.select("p1", "p2", F.col("node").alias("profile_id")).join(labels.withColumnRenamed("node", "profile_id"), "profile_id", "left")
    own = known.select("doc_id", "p1", "p2", "n_shingles").join(named.select("p1", "p2", "profile_id", F.coalesce("label", "profile_id").alias("class_id")), ["p1", "p2"], "left")
    empty = F.col("n_shingles") == 0
    return own.select("doc_id", F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("doc_id")).otherwise(F.col("profile_id")).alias("profile_id"), "n_shingles")


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their class: its least id, one row of it. Rows without id stay.

    Of several rows of that id the one with the least text stays, of equal texts any.
    """
    made = stashes()
    of_rows = classes(docs, threshold, size).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    used = stashes()[len(made) :]
    standing = stash(of_rows.where("doc_id = class_id").select(F.col("doc_id").alias("kept"), "n"), "near-kept")
    drop_stashes(docs.sparkSession, used)
    # Columns by place, so that no name clashes.
    names = docs.columns
    lower = [c.lower() for c in names]
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    key, text = (f"_{lower.index(c)}" for c in ("doc_id", "text"))
    single = plain.join(standing.where("n = 1"), F.col(key) == F.col("kept"), "left_semi")
    repeated = plain.join(standing.where("n > 1"), F.col(key) == F.col("kept"), "left_semi")
    first = repeated.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.col(text).asc_nulls_last()))).where("nth = 1").drop("nth")
    return single.unionByName(first).unionByName(plain.where(F.col(key).isNull())).toDF(*names)
