"""Toxicity of texts that hide their words.

A word that holds digits or signs, repeats a letter three times, or is spelt
out letter by letter went through a noisy channel: letters replaced by look-
alikes, signs put between, letters repeated. The Viterbi decoder walks the
lattice of what each character may stand for (itself, a letter it looks like,
nothing) under a character trigram model of the plain words of all documents
and finds the likeliest word: no state is left out that could still win. Words, restored words and their beginnings are then
scored by a logistic model over those features that tell labels apart.

Labels that are learnt from are a bounded sample. Null and empty texts have the
model's score for a text without features. Labels without text and null labels
and others than 0 and 1 are left out; repeated labels count each; without labels every score is 0.
Every row is scored by itself, repeated ones too; an empty table has no rows. Features of equal worth are taken by name. Other
columns, of any name, don't matter. Long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.shared import map_batches, own_columns, stash, whole_text

#: The bound of the training sample: labelled texts, chosen by a hash of the id.
TRAINING_TEXTS = 20_000
#: The bound of the model: features with a weight.
FEATURES = 4096
#: Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¥": "y", "%": "x", "#": "h", "&": "a",
}
#: Costs of the channel in bits.
COST_ALIKE, COST_DROPPED_SIGN, COST_DROPPED_REPEAT, COST_DROPPED_LETTER, COST_DROPPED_ALIKE = 1.0, 1.0, 1.5, 20.0, 12.0
EDGES = ".,;:!?\"'`()[]{}<>*_-~#$%&|+=/\\^@"
THRICE = re.compile(r"(.)\1\1")
SPELT = re.compile(r"(?<!\S)(?:\S[ ._*-]){3,}\S(?!\S)")


class Restorer:
    """The decoder; ``counts`` are character trigrams, ``^`` before a word and ``$`` after it."""

    def __init__(self, counts: dict[str, int]):
        pairs: Counter = Counter()
        for gram, n in counts.items():
            pairs[gram[:2]] += n
        self.letters = {g[2] for g in counts} - {"$"}
        size = len(self.letters) + 1
        self.bits = {g: -math.log2((n + 0.1) / (pairs[g[:2]] + 0.1 * size)) for g, n in counts.items()}
        self.new = {p: -math.log2(0.1 / (n + 0.1 * size)) for p, n in pairs.items()}
        self.unseen = math.log2(size)
        # Two states differ in the costs of the next two letters at most, so one this much dearer than another never wins.
        self.reach = 2 * max([self.unseen, *self.bits.values(), *self.new.values()]) + 1e-6
        self.cost = lru_cache(maxsize=200_000)(self._cost)

    def _cost(self, context: str, letter: str) -> float:
        known = self.bits.get(context + letter)
        return known if known is not None else self.new.get(context, self.unseen)

    def restore(self, word: str) -> str:
        """The likeliest word behind ``word`` (lower case); the empty string if none is left."""
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # the word so far as its last letter and the word before it
        before = ""
        for seen in word:
            options = [(letter, COST_ALIKE) for letter in LOOKALIKES.get(seen, "")]
            if seen.isalpha():
                options.append((seen, 0.0))
                skip = COST_DROPPED_REPEAT if seen == before else COST_DROPPED_LETTER
            else:
                skip = COST_DROPPED_SIGN if seen not in LOOKALIKES else COST_DROPPED_ALIKE
            before = seen
            reached: dict[str, tuple[float, tuple | None]] = {}
            for context, (bits, text) in states.items():
                if reached.get(context, (math.inf,))[0] > bits + skip:
                    reached[context] = (bits + skip, text)
                for letter, cost in options:
                    total = bits + cost + self.cost(context, letter)
                    to = context[1] + letter
                    if reached.get(to, (math.inf,))[0] > total:
                        reached[to] = (total, (letter, text))
            most = min((bits for bits, _ in reached.values()), default=0.0) + self.reach
            states = {context: x for context, x in reached.items() if x[0] <= most}
        ends = {context: bits + self.cost(context, "$") for context, (bits, _) in states.items()}
        best = min(ends.values())
        return min(spelt(states[context][1]) for context, bits in ends.items() if bits == best)


def spelt(text: tuple | None) -> str:
    letters = []
    while text is not None:
        letter, text = text
        letters.append(letter)
    return "".join(reversed(letters))


def suspicious(core: str) -> bool:
    return not core.isalpha() and any(c.isalpha() or c in LOOKALIKES for c in core) or THRICE.search(core) is not None


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word + "$"] + [word[:k] for k in (4, 5, 6, 7) if len(word) >= k]


def tokens_of(text: str) -> set[str]:
    """The distinct words of a text, and its spelt out words as one each."""
    low = text.lower()
    found = set(low.split())
    found.update(SPELT.findall(low))
    return found


class Reader:
    """Features of a text; remembers words. ``wanted`` limits features to those of a model."""

    def __init__(self, counts: dict[str, int], wanted: dict[str, int] | None = None, room: int = 400_000):
        self.restorer, self.wanted, self.room = Restorer(counts), wanted, room
        self.known: dict[str, tuple] = {}

    def word(self, token: str) -> tuple:
        core = token.strip(EDGES)
        names = set()
        if core:
            names.update(features_of(core))
        if token and (suspicious(core) or core != token and token[0] in LOOKALIKES and token[1:2].isalpha()):
            # A sign at the edge may be a letter; a run of one sign never is.
            bare = re.sub(r"^([^\w])\1+|([^\w])\2+$", "", token)
            for seen in {core, bare.rstrip(".,;:?\"'")}:
                restored = self.restorer.restore(seen) if seen else ""
                if len(restored) > 2:
                    names.update(features_of(restored))
        out = tuple(names) if self.wanted is None else tuple(self.wanted[n] for n in names if n in self.wanted)
        if len(token) <= 40:
            if len(self.known) >= self.room:
                self.known.clear()
            self.known[token] = out
        return out

    def text(self, text: str) -> set:
        get, out = self.known.get, set()
        for token in tokens_of(text):
            found = get(token)
            if found is None:
                found = self.word(token)
            if found:
                out.update(found)
        return out


def count_trigrams(texts: DataFrame) -> dict[str, int]:
    """All character trigrams of the plain words of ``texts``, each word counted once a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: Counter = Counter()
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(c for c in (t.strip(EDGES) for t in tokens_of(text)) if c.isalpha() and not THRICE.search(c))
            for word, n in words.items():
                padded = f"^^{word}$"
                for i in range(len(padded) - 2):
                    grams[padded[i : i + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    rows = map_batches(texts.select("text"), work, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in rows.collect()}


def telling(sample: DataFrame, grams: Broadcast) -> list[str]:
    """The features that tell the labels best, by the log-likelihood ratio of their document counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grams.value)
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[label].update(reader.text(text))
            names = list({*found[0], *found[1]})
            columns = [pa.array(names), *(pa.array([found[k][n] for n in names], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "clean", "toxic"])

    counts = map_batches(sample, work, "name string, clean long, toxic long").groupBy("name").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where("t >= 3")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = float(totals.get(0, 0)), float(totals.get(1, 0))
    if not clean or not toxic:
        return []
    share, n = toxic / (clean + toxic), F.col("c") + F.col("t")
    gain = F.col("t") * F.log2(F.col("t") / n / share) + F.when(F.col("c") > 0, F.col("c") * F.log2(F.col("c") / n / (1 - share))).otherwise(0.0)
    best = counts.where(F.col("t") / n > 2 * share).withColumn("gain", gain).where("gain > 12").orderBy(F.desc("gain"), "name").limit(FEATURES)
    return sorted(r["name"] for r in best.collect())


def fit(rows: list[tuple[np.ndarray, int]], size: int, rounds: int = 400, penalty: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model over present features, by Adam on all rows."""
    of = np.concatenate([np.full(len(x), i) for i, (x, _) in enumerate(rows)]) if rows else np.zeros(0, int)
    at = np.concatenate([x for x, _ in rows]).astype(int) if rows else np.zeros(0, int)
    y = np.array([label for _, label in rows], float)
    w, b = np.zeros(size), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(of, w[at], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.r_[np.bincount(at, error[of], minlength=size) + penalty * w, error.sum()]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[dict[str, int], dict[str, int], np.ndarray, float]:
    """Trigrams of all texts; features, weights, offset from at most ``TRAINING_TEXTS`` labelled texts where ``learn`` holds. Labels other than 0 and 1 are left out."""
    marked = own_columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(learn)
    chosen = marked.select("doc_id", F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(TRAINING_TEXTS)
    texts = own_columns(docs, "doc_id", "text").where("text is not null")
    sample = stash(texts.join(F.broadcast(chosen), "doc_id").select("text", "label").repartition(12), "toxic-sample")
    grams = count_trigrams(texts)
    sent = docs.sparkSession.sparkContext.broadcast(grams)
    names = {n: i for i, n in enumerate(telling(sample, sent))}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value, names)
        for batch in batches:
            found = [sorted(reader.text(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    rows = [(np.array(r["found"], int), r["label"]) for r in map_batches(sample, work, "label int, found array<int>").collect()]
    if not rows:
        return grams, names, np.zeros(0), -30.0
    return grams, names, *fit(rows, len(names))


def score_texts(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    grams, names, weights, offset = train(docs, labels, learn)
    shared = docs.sparkSession.sparkContext.broadcast((grams, names, weights, offset))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, names, weights, offset = shared.value
        reader = Reader(grams, names)
        for batch in batches:
            z = np.array([offset + weights[list(found)].sum() if (found := reader.text(t)) else offset for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = own_columns(docs, "doc_id", "text").select("doc_id", whole_text().alias("text"), held_out.alias("held_out"))
    return map_batches(rows, work, "doc_id long, held_out boolean, score double, predicted int")
