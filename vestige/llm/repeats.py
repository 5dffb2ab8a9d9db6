"""Removal of repeated passages by longest-previous-factor arrays, over all documents.

A window is ``WINDOW`` bytes of one document. Every window that also starts
earlier (smaller id, or same document and earlier start) is *gone*: all its
bytes are removed, the first copy stays. Windows are judged on the input.

One suffix array over all documents would be one task, so the windows are first
dealt out by content:

1. The *gram* of a window is the one of its grams of ``GRAM`` bytes with the least
   hash, of several the leftmost. Equal windows have equal grams at equal places. A
   *piece* is a stretch of windows with the same gram, some 40 on average; each window is in
   one piece.
2. Equal pieces of a batch are taken together before anything is shuffled. Over the corpus,
   of equal pieces the first stays, the windows of the others are gone. So a passage
   that very many documents hold is one piece here, and exact copies cost no more.
3. Different pieces with one gram may still share windows. They meet in a task, which
   builds the suffix array of their bytes by doubling, and the longest-previous-factor array
   from the previous and the next smaller position in suffix order: a window whose
   factor reaches ``WINDOW`` bytes is gone.
4. A gram with more than ``MOST`` different pieces is split without loss: windows are told apart
   by how far the gram lies behind their start, in two halves, then four, and so on; the
   bytes that all windows of such a part share are its new key. After seven rounds
   a part is one window.

Nulls: a null text is empty; rows without id sort before all ids. Rows of one
id are documents of their own, in the order of a hash of their texts; rows equal
in id and text are one document, with the same result. Texts shorter than a
window, empty ones too, lose nothing. Long texts are worked on in overlapping stretches.
What is left may begin inside a character, so it is bytes. An empty table
gives no rows; other columns, of any name, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.llm.shared import fresh_path, map_batches, own_columns, partitions, stash, whole_text
from vestige.llm.shingles import BASE, BASE_INVERSE, BYTE_VALUES, spread

WINDOW = 100
GRAM = 16
#: Different pieces of one gram that meet in a task.
MOST = 500
#: Bytes whose windows are found at once, and whose suffixes are sorted at once.
STRETCH = 1 << 22
SORTED_BYTES = 1 << 20
NO_ID = -(2**63)
#: Bits of a place that hold how many windows a piece has, and how far its gram lies behind the first.
SMALL = 7
#: Halvings until a part is one window.
ROUNDS = 7
#: Shares of the equal parts of hot pieces that are settled apart before they meet.
SHARES = 32


class Powers:
    """Powers of the hash base and of its inverse."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(n + n // 2, b)]) for b in (BASE, BASE_INVERSE))
        return cls.up, cls.down


class Pieces:
    """The pieces of texts laid one after another: ``start`` in the data, ``n`` windows, ``off`` to the gram, hashes of gram (``key``) and piece (``whole``)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        grams, many = WINDOW - GRAM + 1, len(data) - WINDOW + 1
        if many <= 0:
            self.start = self.n = self.off = np.zeros(0, np.int64)
            self.key = self.whole = np.zeros(0, np.uint64)
            return
        up, down = Powers.of(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64)]
            hashes = spread((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
            # The place in the lower bits makes the leftmost of equal grams the least.
            ordered = hashes & ~np.uint64((1 << 24) - 1) | np.arange(len(hashes), dtype=np.uint64)
            least = sliding_minima(ordered, grams)[:many]
            inside = np.ones(many, bool)
            for end in ends[:-1]:
                inside[max(0, end - WINDOW + 1) : end] = False
            begins = inside & np.r_[True, (least[1:] != least[:-1]) | ~inside[:-1]]
            stops = inside & np.r_[(least[1:] != least[:-1]) | ~inside[1:], True]
            self.start = np.flatnonzero(begins)
            self.n = np.flatnonzero(stops) - self.start + 1
            at = (least[self.start] & np.uint64((1 << 24) - 1)).astype(np.int64)
            self.off = at - self.start
            self.key = hashes[at]
            size = self.n + WINDOW - 1
            self.whole = spread((sums[self.start + size] - sums[self.start]) * down[self.start] + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, from running minima of blocks."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, owner, base) of stretches of at most some ``STRETCH`` bytes; a longer text is cut into overlapping ones."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    step = STRETCH - WINDOW + 1
    parts = ((i, a, t[a : a + STRETCH]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - WINDOW + 1), step))

    def laid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
        return data, np.cumsum([len(p[2]) for p in held]), np.array([p[0] for p in held]), np.array([p[1] for p in held])

    for part in parts:
        if held and size + len(part[2]) > STRETCH:
            yield laid()
            held, size = [], 0
        held.append(part)
        size += len(part[2])
    if held:
        yield laid()


def runs_of(start: np.ndarray, n: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows, by owner and start, with those that touch taken together."""
    order = np.lexsort((start, owner))
    start, n, owner = start[order], n[order], owner[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + n[:-1])] if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], np.add.reduceat(n, first) if len(first) else n, owner[first]


FOUND = "key long, whole long, doc_id long, part long, place long"


def find_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` (doc_id, part, text), of equal ones of a batch the first.

    ``place``: start, windows and gram offset in one number. A row without
    windows stands for others that the batch has settled: ``whole`` windows from its start are gone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((parts, ids))] = np.arange(len(ids))
            held: list[list[np.ndarray]] = []
            for data, ends, owner, base in stretches(texts):
                found = Pieces(data, ends)
                which = np.searchsorted(ends, found.start, side="right")
                text_start = np.r_[0, ends[:-1]]
                held.append([found.key, found.whole, found.start - text_start[which] + base[which], found.n, found.off, owner[which]])
            if not held:
                continue
            key, whole, start, n, off, owner = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((start, rank[owner], whole, key))
            key, whole, start, n, off, owner = (x[order] for x in (key, whole, start, n, off, owner))
            again = np.r_[False, (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])] if len(key) else np.zeros(0, bool)
            gone_start, gone_n, gone_owner = runs_of(start[again], n[again], owner[again])
            one = ~again
            place = np.r_[(start[one] << 2 * SMALL) | (n[one] << SMALL) | off[one], gone_start << 2 * SMALL]
            whose = np.r_[owner[one], gone_owner]
            with np.errstate(over="ignore"):
                anywhere = spread(ids[gone_owner].view(np.uint64) + gone_start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            columns = [np.r_[key[one], anywhere].view(np.int64), np.r_[whole[one].view(np.int64), gone_n], ids[whose], parts[whose], place]
            for a in range(0, len(place), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 65_536]) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    return map_batches(docs.select("doc_id", "part", "text"), work, FOUND)


SPAN = ("doc_id", "part", "start", "n")


def settle(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``nth`` among equal ones and ``rivals``, the different pieces of its key; those that are neither gone nor contested are left out.

    Equal pieces of one batch are one row already, so a key's rows here are its different pieces, and equal ones of other batches.
    """
    equal = W.partitionBy("key", "whole").orderBy("doc_id", "part", "place")
    dealt = pieces.repartition(partitions(pieces.sparkSession), "key").withColumn("nth", F.row_number().over(equal))
    dealt = dealt.withColumn("rivals", F.sum((F.col("nth") == 1).cast("long")).over(W.partitionBy("key")))
    return placed(dealt).where("nth > 1 OR rivals > 1 OR n = 0")


def settle_hot(parts: DataFrame) -> DataFrame:
    """``settle`` for parts of hot pieces: very many different ones may have one key, so keys are only counted, never gathered."""
    equal = W.partitionBy("key", "whole").orderBy("doc_id", "part", "place")
    dealt = stash(parts.withColumn("nth", F.row_number().over(equal)), "repeat-dealt")
    rivals = dealt.where("nth = 1").groupBy("key").agg(F.count("*").alias("rivals"))
    return placed(dealt.join(rivals, "key")).where("nth > 1 OR rivals > 1")


def placed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their place taken apart."""
    small = F.lit((1 << SMALL) - 1)
    return pieces.withColumns({"start": F.shiftright("place", 2 * SMALL), "n": F.shiftright("place", SMALL).bitwiseAND(small), "off": F.col("place").bitwiseAND(small)}).drop("place")


def gone_rows(settled: DataFrame) -> DataFrame:
    return settled.where("nth > 1 OR n = 0").select("doc_id", "part", "start", F.when(F.col("n") == 0, F.col("whole")).otherwise(F.col("n")).alias("n"))


HELD = "key long, doc_id long, part long, start long, n long, off long, rivals long, content binary"


def with_bytes(contested: DataFrame, docs: DataFrame) -> DataFrame:
    """Contested pieces with their bytes, cut from the texts."""
    lists = contested.groupBy("doc_id", "part").agg(*[F.collect_list(F.col(c).cast(k)).alias(f"{c}s") for c, k in (("key", "long"), ("start", "long"), ("n", "int"), ("off", "int"), ("rivals", "long"))])
    met = docs.join(lists, ["doc_id", "part"]).select("doc_id", "part", "text", "keys", "starts", "ns", "offs", "rivalss")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column(2)[r].as_py().encode()
                keys, starts, ns, offs, rivals = (batch.column(c)[r].values.to_numpy() for c in range(3, 8))
                content = [text[a : a + n + WINDOW - 1] for a, n in zip(starts.tolist(), ns.tolist())]
                many = len(content)
                ids, parts = (pa.array([batch.column(c)[r].as_py()] * many, pa.int64()) for c in (0, 1))
                for a in range(0, many, 8192):
                    cut = slice(a, a + 8192)
                    columns = [pa.array(keys[cut]), ids[cut], parts[cut], pa.array(starts[cut]), pa.array(ns[cut].astype(np.int64)), pa.array(offs[cut].astype(np.int64)), pa.array(rivals[cut]), pa.array(content[cut], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HELD.split(", ")])

    return map_batches(met, work, HELD)


SPLIT = "key long, whole long, doc_id long, part long, place long, content binary"


def hash_of(*parts: bytes) -> int:
    digest = hashlib.blake2b(digest_size=8)
    for p in parts:
        digest.update(p)
    return int.from_bytes(digest.digest(), "little", signed=True)


def halved(piece: tuple[int, int, int, bytes], bits: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(key, whole, start, n, off, bytes) of the parts of a piece (start, n, off, bytes): windows whose gram lies 2**bits * k and up to 2**bits * (k + 1) - 1 behind their start."""
    start, n, off, content = piece
    i = 0
    while i < n:
        k = (off - i) >> bits
        many = min(n - i, off - i - (k << bits) + 1)
        own = content[i : i + many + WINDOW - 1]
        least, most = k << bits, min((k + 1 << bits) - 1, WINDOW - GRAM)
        gram = off - i
        common = own[gram - least : gram + WINDOW - most]
        yield hash_of(k.to_bytes(1, "little"), common), hash_of(own), start + i, many, gram, own
        i += many


def split(hot: DataFrame, bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, part, start, n, off, content in zip(*(batch.column(c).to_pylist() for c in range(6))):
                for key, whole, a, many, gram, own in halved((start, n, off, content), bits):
                    for column, value in zip(out, (key, whole, doc_id, part, a << 2 * SMALL | many << SMALL | gram, own)):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[c.split()[0] for c in SPLIT.split(", ")])

    return map_batches(hot.select(*SPAN, "off", "content"), work, SPLIT)


# Suffix arrays ---------------------------------------------------------------


def dense_ranks(values: np.ndarray, below: int) -> np.ndarray:
    """Each value's rank among the distinct ones, from 1. ``below`` bounds the values."""
    n = len(values)
    if below < 1 << 43 and n <= 1 << 20:
        ordered = np.sort(values.astype(np.uint64) << np.uint64(20) | np.arange(n, dtype=np.uint64))
        order, ordered = (ordered & np.uint64((1 << 20) - 1)).astype(np.int64), ordered >> np.uint64(20)
    else:
        order = np.argsort(values, kind="stable")
        ordered = values[order]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.r_[1, (ordered[1:] != ordered[:-1]).astype(np.int64)]) if n else 0
    return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest smaller one before it, -1 without one; by pointer jumping."""
    out = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while True:
        open_ = open_[out[open_] >= 0]
        open_ = open_[values[out[open_]] > values[open_]]
        if not len(open_):
            return out
        out[open_] = out[out[open_]]


def previous_factors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts that end at ``ends``: the places where a window starts, and whether their longest previous factor has ``WINDOW`` bytes.

    Suffixes, which end with their text, are ordered by their first 112 bytes (7,
    doubled four times), then by place. The longest match of a place with any
    earlier one is that with the previous or the next smaller place in this order.
    """
    n = len(data)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)
    values = np.zeros(n, np.int64)
    padded = np.r_[data.astype(np.int64) + 1, np.zeros(7, np.int64)]
    for i in range(7):
        values = values << 9 | np.where(left > i, padded[i : i + n], 0)
    ranks, depth, at_56 = dense_ranks(values, 1 << 63), 7, None
    while depth < 112:
        most = int(ranks.max(initial=0)) + 1
        after = np.zeros(n, np.int64)
        after[: n - depth] = np.where(left[: n - depth] > depth, ranks[depth:], 0)
        ranks, depth = dense_ranks(ranks * most + after, most * most), 2 * depth
        if depth == 56:
            at_56 = ranks
    windows = np.flatnonzero(left >= WINDOW)
    suffixes = windows[np.argsort(ranks[windows], kind="stable")]
    before = nearest_smaller(suffixes)
    behind = len(suffixes) - 1 - nearest_smaller(suffixes[::-1])[::-1]
    long_enough = np.zeros(len(suffixes), bool)
    for other in (before, np.where(behind == len(suffixes), -1, behind)):
        some = np.flatnonzero(other >= 0)
        p, q = suffixes[some], suffixes[other[some]]
        # A match of 100 bytes is one of the first 56 and one of the last 56 of them.
        long_enough[some] |= (at_56[p] == at_56[q]) & (at_56[p + WINDOW - 56] == at_56[q + WINDOW - 56])
    out = np.zeros(n, bool)
    out[suffixes] = long_enough
    return windows, out[windows]


def later_windows(pieces: DataFrame) -> DataFrame:
    """doc_id, part, start, n: windows of pieces (key, doc_id, part, start, content) that occur earlier among those of their key."""

    def judged(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[1:4])
        data = np.frombuffer(b"".join(r[4] for r in held), np.uint8)
        ends = np.cumsum([len(r[4]) for r in held])
        windows, later = previous_factors(data, ends)
        at = windows[later]
        which = np.searchsorted(ends, at, side="right")
        start, n, which = runs_of(at - np.r_[0, ends[:-1]][which] + np.array([r[3] for r in held])[which], np.ones(len(at), np.int64), which)
        columns = [np.array([r[1] for r in held])[which], np.array([r[2] for r in held])[which], start, n]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(SPAN))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, since = 0, 0  # ``since``: where the last key began
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if held and row[0] != held[-1][0]:
                    since = len(held)
                if size + len(row[4]) > SORTED_BYTES and since:
                    yield judged(held[:since])
                    held, since = held[since:], 0
                    size = sum(len(r[4]) for r in held)
                held.append(row)
                size += len(row[4])
        if held:
            yield judged(held)

    dealt = pieces.select("key", "doc_id", "part", "start", "content").repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key")
    return map_batches(dealt, work, "doc_id long, part long, start long, n long")


# The whole -------------------------------------------------------------------


def gone_windows(docs: DataFrame) -> DataFrame:
    """doc_id, part, start, n: the windows of ``docs`` (doc_id, part, text) that are gone."""
    spark = docs.sparkSession
    settled = stash(settle(find_pieces(docs)), "repeat-pieces")
    out = gone_rows(settled)
    contested = stash(with_bytes(settled.where("nth = 1 AND rivals > 1 AND n > 0").select("key", *SPAN, "off", "rivals"), docs), "repeat-bytes")
    hot = contested.where(F.col("rivals") > MOST)
    small = contested.where(F.col("rivals") <= MOST)
    bits = ROUNDS
    while bits and not hot.isEmpty():
        bits -= 1
        # Very many parts may be equal: of each share of them one goes on.
        share = F.pmod(F.xxhash64("doc_id", "part", "place"), F.lit(SHARES))
        in_share = W.partitionBy("key", "whole", share).orderBy("doc_id", "part", "place")
        parts = stash(split(hot, bits).withColumn("nth", F.row_number().over(in_share)), "repeat-parts")
        out = out.unionByName(gone_rows(placed(parts.where("nth > 1"))))
        settled = stash(settle_hot(parts.where("nth = 1").drop("nth")), "repeat-split")
        out = out.unionByName(gone_rows(settled))
        rest = settled.where("nth = 1 AND rivals > 1")
        small = small.unionByName(rest.where(F.col("rivals") <= MOST).select(small.columns))
        hot = rest.where(F.col("rivals") > MOST)
    path = fresh_path(spark, "repeat-later")
    later_windows(small).write.option("compression", "zstd").parquet(path)
    return out.unionByName(spark.read.schema("doc_id long, part long, start long, n long").parquet(path))


SHORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, what is left of the text's UTF-8, of every row."""
    own = own_columns(docs, "doc_id", "text").withColumn("text", whole_text())
    repeated = not own.groupBy("doc_id").count().where("count > 1").isEmpty()
    part = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    keyed = own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), part.alias("part"), "text", F.col("doc_id").alias("own_id"))
    once = keyed.select("doc_id", "part", "text")
    spans = gone_windows(once.dropDuplicates(["doc_id", "part"]) if repeated else once)
    lists = spans.groupBy("doc_id", "part").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    met = keyed.join(lists, ["doc_id", "part"], "left").select("own_id", "text", "starts", "ns")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for r in range(batch.num_rows):
                text = batch.column(1)[r].as_py().encode()
                removed, runs, kept = 0, 0, text
                if batch.column(2)[r].is_valid:
                    starts, ns = (batch.column(c)[r].values.to_numpy() for c in (2, 3))
                    order = np.argsort(starts, kind="stable")
                    begin, end = starts[order], np.maximum.accumulate((starts + ns)[order] + WINDOW - 1)
                    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
                    begin, end = begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]
                    removed, runs = int((end - begin).sum()), len(begin)
                    kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
                for column, value in zip(out, (len(text), removed, runs, kept)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out, kinds)]], names=[c.split()[0] for c in SHORT.split(", ")])

    return map_batches(met, work, SHORT)
