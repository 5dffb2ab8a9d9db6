"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted over
a bounded sample of labelled texts. A byte is coded in the longest context
known; where that context never saw the byte, an escape (method C, seen bytes
excluded) leads to the next shorter one, at last to equal chances for all
bytes left. Counts are frozen after training, so the exact code length of
every byte in every context is tabled once for all languages; a text's code
length is the sum of its table entries, and the shortest code names the language.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the
language that sorts first. Without any training rows all texts are ``und``. Repeated rows count
each in training, and are told each by itself; an empty table has no rows. Other columns, of any
name, don't matter. Long texts are coded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.shared import map_batches, own_columns, whole_text
from vestige.llm.shingles import groups

ORDER = 3
#: The bound of the training sample: texts of each language, about so many, chosen by a hash of the id.
TRAINING_TEXTS = 2000
#: Languages up to which their sizes are broadcast.
MOST_LANGUAGES = 10_000
PAD = b"\n" * ORDER


def held_out(of: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == rest, F.lit(False))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of four bytes, the text's start padded, occurs in each language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for lang in sorted(set(langs)):
                for group in groups(t for t, own in zip(texts, langs) if own == lang):
                    grams = np.concatenate([windows(PAD + t) for t in group])
                    found, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return map_batches(docs, work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def windows(data: bytes) -> np.ndarray:
    """Every run of four bytes, as a big-endian number."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


class Trees:
    """Frozen code lengths. ``rows[c]`` is the table row of a context of three symbols, ``bits[row, symbol]`` the bits in each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        grams = np.concatenate([counts[k][0] for k in self.langs])
        alphabet = np.unique([grams >> s & 0xFF for s in (24, 16, 8, 0)])
        #: Symbol 0 stands for all bytes never seen.
        self.symbol = np.zeros(256, np.int64)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        a = self.n_symbols = len(alphabet) + 1
        coded, seen3 = [], np.zeros(a**3, bool)
        for k in self.langs:
            gram, n = counts[k]
            code = sum(self.symbol[gram >> s & 0xFF] * a**p for s, p in ((24, 3), (16, 2), (8, 1), (0, 0)))
            coded.append((code, n))
            seen3[code // a] = True
        deep = np.flatnonzero(seen3)
        # Table rows: all contexts of 2, 1 and 0 symbols that may be needed, then the deep ones.
        pairs = np.unique(np.concatenate([c // a % a**2 for c, _ in coded]))
        row2 = np.full(a**2, -1)
        row2[pairs] = np.arange(len(pairs))
        ones = len(pairs) + np.arange(a)
        row2 = np.where(row2 < 0, ones[np.arange(a**2) % a], row2)
        self.rows = np.tile(row2, a).astype(np.int32)
        self.rows[deep] = len(pairs) + a + np.arange(len(deep))
        self.bits = np.empty((len(pairs) + a + len(deep), a, len(self.langs)), np.float32)
        for at, (code, n) in enumerate(coded):
            by = [np.bincount(code % a, n, minlength=a).reshape(1, a).astype(float)]
            by.append(np.bincount(code % a**2, n, minlength=a**2).reshape(a, a).astype(float))
            for contexts, size in ((pairs, 3), (deep, 4)):
                place = np.full(a ** (size - 1), -1)
                place[contexts] = np.arange(len(contexts))
                tail = code % a**size
                where = place[tail // a]
                table = np.zeros((len(contexts), a))
                np.add.at(table, (where[where >= 0], tail[where >= 0] % a), n[where >= 0])
                by.append(table)
            zero, one = np.zeros(a, np.int64), np.arange(a)
            place2 = np.full(a**2, -1)
            place2[pairs] = np.arange(len(pairs))
            deep2 = place2[deep % a**2]
            chains = [
                (slice(0, len(pairs)), [by[2], by[1][pairs % a], by[0][zero[pairs % a]]]),
                (slice(len(pairs), len(pairs) + a), [by[1], by[0][zero[one]]]),
                (slice(len(pairs) + a, None), [by[3], by[2][deep2], by[1][deep % a], by[0][zero[deep % a]]]),
            ]
            for part, chain in chains:
                self.bits[part, :, at] = code_lengths(chain)

    def of(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)
        x = self.symbol[data]
        a = self.n_symbols
        ends = np.cumsum([len(t) + ORDER for t in texts])
        starts = np.r_[0, ends[:-1]]
        own = np.ones(len(x), bool)
        for k in range(ORDER):
            own[starts + k] = False
        at = np.flatnonzero(own)
        bits = self.bits[self.rows[(x[at - 3] * a + x[at - 2]) * a + x[at - 1]], x[at]]
        out = np.zeros((len(texts), len(self.langs)))
        full = np.array([len(t) > 0 for t in texts])
        first = np.cumsum([0] + [len(t) for t in texts])[:-1]
        if full.any():
            out[full] = np.add.reduceat(bits, first[full], axis=0, dtype=np.float64)
        return out


def code_lengths(chain: list[np.ndarray]) -> np.ndarray:
    """Bits of every symbol in every context, the counts of the context first, then of its ever shorter ends."""
    free = np.ones_like(chain[0], bool)
    left = np.ones((len(chain[0]), 1))
    chance = np.zeros_like(chain[0])
    for counts in chain:
        counts = np.where(free, counts, 0)
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        chance += left * counts / whole
        all_seen = kinds == free.sum(1, keepdims=True)
        left = np.where(total == 0, left, np.where(all_seen, 0, left * kinds / whole))
        # A context that saw every symbol needs no escape: its chances are scaled to one.
        chance = np.where(all_seen & (total > 0) & (counts > 0), chance * whole / np.maximum(total, 1), chance)
        free &= counts == 0
    chance += np.where(free, left / np.maximum(free.sum(1, keepdims=True), 1), 0)
    return -np.log2(np.maximum(chance, 1e-30))


def train(docs: DataFrame, learn: Column) -> Trees | None:
    """Trees of all values of ``lang``, from at most ``TRAINING_TEXTS`` texts of each."""
    rows = own_columns(docs, "doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A share of each language's rows by a hash of the id: no ranking, so no task holds a language.
    share = F.lit(float(TRAINING_TEXTS)) / F.col("n")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES:
        sizes = F.broadcast(sizes)
    sample = rows.join(sizes, "lang").where(draw < share).select("lang", "text")
    table = count_grams(sample).toPandas()  # of a bounded sample
    if not len(table):
        return None
    return Trees({k: (g["gram"].to_numpy(), g["n"].to_numpy()) for k, g in table.groupby("lang")})


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, lang_pred, score of every document; trained on the rows where ``learn`` holds."""
    trees = train(docs, learn)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, model = regex.compile(r"\p{L}").search, shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named = [model is not None and letter(t) is not None for t in texts]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            chosen = [i for i, own in enumerate(named) if own]
            bits = [model.of(g) for g in groups(texts[i].encode() for i in chosen)] if chosen else []
            if bits:
                bits = np.concatenate(bits)
                best = bits.argmin(1)
                gap = np.minimum(bits - bits.min(1, keepdims=True), 1000)
                scores[chosen] = 1 / np.exp2(-gap).sum(1)
                for i, k in zip(chosen, best):
                    langs[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = own_columns(docs, "doc_id", "text").select("doc_id", whole_text().alias("text"), (~learn).alias("held_out"))
    return map_batches(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
