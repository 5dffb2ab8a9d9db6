"""Alignment of two tokenizers' tokens of the same bytes, by pointer jumping.

Tokenizer A is a byte-level one of the tokenizers library, B a sentencepiece
model; both see a space and the text. Where tokens of both end at one byte,
the text is cut; between two cuts lies a *group*, a component of the tokens
that overlap. Every token points to the token that overlaps it and reaches
farthest to the right (of two that reach as far, B's); doubling the pointers
brings each to the last token of its group, which names it.

Both tokenizers end a token before a space or line end that follows another
character than white space: A's pre-tokens do, and no piece of B holds a space
or line end behind anything else. So a text is its *units* laid one after another,
each is tokenized and aligned once in a worker's memory, and what holds for a text
is put together from its units. Words repeat, so few units are new.

Counts of id pairs over the corpus come from *blocks*: some megabytes of texts
each, with the distinct pairs of the block as rows. Those are summed by pair
over all blocks, joined back, and gathered by block again: as many rows as a block
has pairs. Nothing but the highest count of each id of B (as many as its
vocabulary has) is broadcast.

Nulls: null and empty texts, and texts whose tokens' joined bytes differ from
space and text (which a text with U+2581 has), have no tokens: zeros, and no part in
the counts. Special tokens' strings are plain text. Rows with null or repeated
ids are rows of their own. Very long texts are cut into units in stretches, and make a
block of their own. Ties: every pair whose count is the highest of its B id counts.
An empty table gives no rows; other columns, of any name, don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.bpe_cache import byte_alphabet
from vestige.llm.shared import map_batches, own_columns, stash, whole_text

#: A space or line end with the white space behind it, then all up to the next one that follows another character.
UNIT = re.compile(r"[ \n]\s*+(?:\S++(?:[^\S \n]\s*+)?+)*+")
#: Where a long text may be parted.
CUT = re.compile(r"(?<=\S)[ \n]")
STRETCH = 1 << 20
#: Bytes of texts in a block.
BLOCK_BYTES = 4 << 20
#: Units, and characters of them, that a worker remembers; beyond, it starts afresh with the next block.
ROOM, ROOM_CHARS = 300_000, 16 << 20
#: Bytes of new units that are aligned at once.
NEW_BYTES = 1 << 17


def units_of(text: str) -> list[str]:
    """The units of a space and ``text``."""
    whole, out, at = " " + text, [], 0
    while at < len(whole):
        cut = CUT.search(whole, at + STRETCH) if len(whole) - at > STRETCH else None
        end = cut.start() if cut else len(whole)
        out += UNIT.findall(whole, at, end)
        at = end
    return out


# Alignment -------------------------------------------------------------------


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each token's group, for A's and B's tokens of one stretch of bytes, by where they end.

    Tokens are numbered A's first. A token's last byte lies in one token of the
    other kind; if that reaches farther it is the farthest that overlaps.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    of_a = np.searchsorted(ends_b, ends_a)  # B's token over the last byte of A's: it reaches as far or farther
    of_b = np.searchsorted(ends_a, ends_b)
    pointer = np.concatenate([n_a + of_a, np.where(ends_a[of_b] > ends_b, of_b, n_a + np.arange(n_b))])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer[:n_a], pointer[n_a:]
        pointer = further


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A's token, B's token) that overlap, in A's order."""
    starts_a = np.r_[0, ends_a[:-1]]
    first = np.searchsorted(ends_b, starts_a, side="right")
    last = np.searchsorted(ends_b, ends_a, side="left")
    many = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), many)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + first[a]


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + len(values), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    def of(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    """Both tokenizers, and the aligned units that a worker remembers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: bytes([i]) for i, c in enumerate(byte_alphabet())}
        self.bytes_a = {i: b"".join(byte_of.get(c, c.encode()) for c in t) for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a piece holds a space or line end behind another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.most = max(max(self.bytes_a), len(pieces)) + 1
        self.size_a = np.zeros(self.most, np.int64)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.size_b = np.array(list(map(len, self.bytes_b)))
        self.atoms = [f"{i}{mark}" for mark in ",|;\n" for i in range(self.most)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.shown: list[str] = []
        self.good = Growing(bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (Growing(np.int64) for _ in range(4))
        self.first = Growing(np.int64)  # of a unit's links
        self.link_a, self.link_b = Growing(np.int32), Growing(np.int32)

    def learn(self, units: set[str]) -> None:
        """Tokenize and align units that are new."""
        fresh = sorted(units.difference(self.known))
        at, size = 0, 0
        for i, unit in enumerate(fresh):
            size += len(unit)
            if size > NEW_BYTES:
                self._align(fresh[at : i + 1])
                at, size = i + 1, 0
        if at < len(fresh):
            self._align(fresh[at:])

    def _align(self, units: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # A line end is a token of B's own, so what follows it is tokenized as inside a text.
        ids_b = [ids[2:] for ids in self.b.encode(["\n" + u for u in units], num_threads=1)]
        good = self._same_bytes(units, ids_a, ids_b)
        for i in np.flatnonzero(~good).tolist():
            ids_a[i], ids_b[i] = [], []
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        of_a, of_b = terminals(ends_a, ends_b)
        left, right = overlaps(ends_a, ends_b)
        owner_a = np.repeat(np.arange(len(units)), n_a)
        last_a, last_b = np.r_[of_a[1:] != of_a[:-1], True][: len(of_a)], np.r_[of_b[1:] != of_b[:-1], True][: len(of_b)]
        n_groups, n_links = (np.bincount(x, minlength=len(units)) for x in (owner_a[last_a], owner_a[left]))
        self.shown += self._shown(flat_a, last_a, flat_b, last_b, good, n_groups)
        for column, values in ((self.good, good), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links)):
            column.add(values)
        self.first.add(self.link_a.n + np.cumsum(n_links) - n_links)
        self.link_a.add(flat_a[left])
        self.link_b.add(flat_b[right])
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.chars += sum(map(len, units))

    def _same_bytes(self, units: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> np.ndarray:
        """Of each unit whether both tokenizers' tokens give its bytes; of all at once, and only if they don't one by one."""
        joined = ["\0".join(units).encode()]
        for ids, raw in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            joined.append(b"\0".join([b"".join(map(raw.__getitem__, x)) for x in ids]))
        if joined[0] == joined[1] == joined[2] and joined[0].count(b"\0") == len(units) - 1:
            return np.ones(len(units), bool)
        return np.array([u.encode() == b"".join(map(self.bytes_a.__getitem__, x)) == b"".join(map(self.bytes_b.__getitem__, y)) for u, x, y in zip(units, ids_a, ids_b)])

    def _shown(self, flat_a: np.ndarray, last_a: np.ndarray, flat_b: np.ndarray, last_b: np.ndarray, good: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """Each unit's groups as text: ``a1,a2|b1;a3|b2,b3``. Written for all units in one, and parted again."""
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        ends_unit = np.zeros(int(n_groups.sum()), bool)
        ends_unit[np.cumsum(n_groups[good]) - 1] = True
        # What stands behind a token: a comma inside a group, a bar behind A's, then a semicolon or, behind a unit, a line end.
        behind_a = np.where(last_a, 1, 0)
        behind_b = np.where(last_b, np.where(ends_unit[group_b], 3, 2), 0)
        atoms = np.r_[behind_a * self.most + flat_a, behind_b * self.most + flat_b][order]
        written = iter("".join(map(self.atoms.__getitem__, atoms.tolist())).split("\n"))
        return [next(written) if fine else "" for fine in good.tolist()]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each pair of tokenizers in a Python worker."""
    return Aligner(path_a, path_b)


# Blocks ----------------------------------------------------------------------

COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK = f"block long, pairs array<long>, counts array<long>, docs array<struct<{COLUMNS.replace(' long', ':bigint').replace(' string', ':string')}>>, units binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as one blob."""
    parts = []
    for x in arrays:
        kind = np.dtype("<u2" if x.max(initial=0) < 1 << 16 else "<u4" if x.max(initial=0) < 1 << 32 else "<u8")
        parts += [np.array([kind.itemsize, len(x)], "<u8").tobytes(), x.astype(kind).tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def unsqueezed(blob: bytes) -> Iterator[np.ndarray]:
    raw, at = zstandard.decompress(blob), 0
    while at < len(raw):
        size, n = np.frombuffer(raw, "<u8", 2, at).tolist()
        yield np.frombuffer(raw, f"<u{size}", n, at + 16).astype(np.int64)
        at += 16 + size * n


def sums_by(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``many`` values."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(many)
    return total[ends] - total[ends - many]


def block_of(maker: Aligner, ids: list, texts: list[str], vocabulary: int) -> tuple:
    """One block: its distinct pairs and their links, the texts' own numbers, and which units each text has."""
    if len(maker.known) > ROOM or maker.chars > ROOM_CHARS:
        maker.forget()
    units = [units_of(t) if t else [] for t in texts]
    maker.learn(set(chain.from_iterable(units)))
    many = np.fromiter(map(len, units), np.int64, len(units))
    at = np.fromiter(map(maker.known.__getitem__, chain.from_iterable(units)), np.int64, int(many.sum()))
    del units
    good = sums_by(~maker.good.of()[at], many) == 0
    at = at[np.repeat(good, many)]
    many = np.where(good, many, 0)
    numbers = [sums_by(column.of()[at], many) for column in (maker.n_a, maker.n_b, maker.n_groups, maker.n_links)]
    shown, hashes, edge = list(map(maker.shown.__getitem__, at.tolist())), [], 0
    for n in many.tolist():
        hashes.append(hashlib.sha256(";".join(shown[edge : edge + n]).encode()).hexdigest() if n else "")
        edge += n
    own, which = np.unique(at, return_inverse=True)
    links = maker.n_links.of()[own]
    place = np.arange(int(links.sum())) + np.repeat(maker.first.of()[own] - np.cumsum(links) + links, links)
    pairs, pair_of = np.unique(maker.link_a.of()[place].astype(np.int64) * vocabulary + maker.link_b.of()[place], return_inverse=True)
    counts = np.bincount(pair_of, np.repeat(np.bincount(which, minlength=len(own)), links), minlength=len(pairs)).astype(np.int64)
    docs = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), row)) for row in zip(ids, *(x.tolist() for x in numbers), hashes)]
    return pairs, counts, docs, squeezed(many, which, links, pair_of)


def blocks(docs: DataFrame, path_a: str, path_b: str, vocabulary: int) -> DataFrame:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in COLUMNS.split(", ")])), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, part, number = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[str] = []
        size = 0

        def made() -> pa.RecordBatch:
            values = (part << 32 | number, *block_of(maker, ids, texts, vocabulary))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "pairs", "counts", "docs", "units"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield made()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield made()

    return map_batches(docs, work, BLOCK)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    held = stash(blocks(own_columns(docs, "doc_id", "text").withColumn("text", whole_text()), path_a, path_b, vocabulary), "aligned")
    met = held.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x")).select("block", "at", "x.pairs", "x.counts").withColumnRenamed("pairs", "pair")
    totals = met.groupBy("pair").agg(F.sum("counts").alias("total"))
    totals = stash(totals, "pair-totals")
    best = totals.groupBy((F.col("pair") % vocabulary).alias("b")).agg(F.max("total").alias("most"))  # at most as many rows as B has ids
    judged = totals.withColumn("b", F.col("pair") % vocabulary).join(F.broadcast(best), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = met.select("block", "at", "pair").join(judged, "pair").groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("total").alias("totals"), F.collect_list("best").alias("best"))
    whole = held.select("block", "docs", "units").join(back, "block", "left").select("docs", "units", "at", "totals", "best")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                many, which, links, pair_of = unsqueezed(batch.column(1)[r].as_py())
                total, best = np.zeros(int(pair_of.max(initial=-1)) + 1, np.int64), np.zeros(int(pair_of.max(initial=-1)) + 1, np.int64)
                if batch.column(2)[r].is_valid:
                    at = batch.column(2)[r].values.to_numpy()
                    total[at] = batch.column(3)[r].values.to_numpy()
                    best[at] = batch.column(4)[r].values.to_numpy(zero_copy_only=False)
                of_docs = [sums_by(sums_by(x[pair_of], links)[which], many) for x in (best, total)]
                rows = batch.column(0)[r].values
                own = [rows.field(i) for i in range(6)]
                columns = [*own[:5], *[pa.array(x) for x in of_docs], own[5]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return map_batches(whole, work, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
