"""The registered queries' own results, and models' inner sums, against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vestige.llm import fingerprints, language_id, pii, queries, toxicity
from vestige.llm.shared import documents
from vestige.llm.shingles import shingle_hashes


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).select("doc_id", "text").collect()}


def library(name):
    tokenizer = Tokenizer.from_file(queries.tokenizer_file(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1_base_rule(spark, sf_dir, rows):
    for r in queries.op1_quality_rules(spark, sf_dir).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]])
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (len(words), len(covered), failed)
        assert not (failed and r["kept"])


def test_op2_digests(spark, sf_dir, rows):
    lib = library("word_bpe_49k.json")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op2_bpe(spark, sf_dir).collect()}
    for k, text in rows.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert got[k] == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op3_pieces(spark, sf_dir, rows):
    lib, found = library("byte_bpe_50k.json"), queries.op3_best_fit_packing(spark, sf_dir).collect()
    of_doc, of_sequence, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in found:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(of_doc) == set(rows)
    for k, text in rows.items():
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        pieces = sorted(of_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]] and sum(r["length"] for r in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 1024) and all(r["length"] == 1024 for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(raw(ids[r["start"] : r["start"] + r["length"]]))
    for places in of_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(of_sequence) <= 1.02 * -(-total // 1024) + 1


def test_op6_minima(spark, sf_dir, rows):
    def minima(text):
        hashes = [int(h) for h in shingle_hashes([text.encode()])[0]]
        return [min(((h * int(a) + int(b)) % 2**64 >> 32 for h in hashes), default=2**32 - 1) for a, b in zip(fingerprints.MULTIPLIERS, fingerprints.ADDENDS)]

    shown = lambda xs: b"".join(x.to_bytes(4, "big") for x in xs).hex()
    near = lambda x, y: sum(a == b for a, b in zip(x, y)) / 64
    order = sorted(rows)
    got = {r["doc_id"]: r for r in queries.op6_fingerprints(spark, sf_dir).collect()}
    for at in range(0, len(order), 7):
        text, after = rows[order[at]], rows[order[(at + 1) % len(order)]]
        if len(text) > 4000:
            continue
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, r = minima(text), minima(edited), got[order[at]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(changed))
        assert (r["near_edited"], r["near_next"]) == (near(own, changed), near(own, minima(after)))


def plain_code_lengths(texts):
    """bits(lang, text) under trees of contexts of up to three bytes, counted and coded byte by byte."""
    seen = {}
    for lang, own in texts.items():
        tree = seen[lang] = [collections.defaultdict(collections.Counter) for _ in range(4)]
        for t in own:
            data = language_id.PAD + t.encode()
            for i in range(3, len(data)):
                for k in range(4):
                    tree[k][data[i - k : i]][data[i]] += 1
    alphabet = {b for own in texts.values() for t in own for b in language_id.PAD + t.encode()}
    size = len(alphabet) + 1

    def bits(lang, text):
        data, total = language_id.PAD + text.encode(), 0.0
        data = [b if b in alphabet else -1 for b in data]
        for i in range(3, len(data)):
            context = lambda k: bytes(data[i - k : i]) if -1 not in data[i - k : i] else None
            known = lambda k: context(k) is not None and any(context(k) in seen[x][k] for x in seen)
            deepest = 3 if known(3) else 2 if known(2) else 1
            left, gone, chance = 1.0, set(), None
            for k in range(deepest, -1, -1):
                here = {b: n for b, n in (seen[lang][k].get(context(k), {}) if context(k) is not None else {}).items() if b not in gone}
                if not here:
                    continue
                every = len(here) == size - len(gone)
                whole = sum(here.values()) + (0 if every else len(here))
                if data[i] in here:
                    chance = left * here[data[i]] / whole
                    break
                left *= 0 if every else len(here) / whole
                gone |= set(here)
            total -= math.log2(chance if chance is not None else left / (size - len(gone)))
        return total

    return bits


def test_op9_code_lengths():
    draw = random.Random(5)
    texts = {"x": ["".join(draw.choice("aab c") for _ in range(60)) for _ in range(9)], "y": ["".join(draw.choice("bcdé ") for _ in range(50)) for _ in range(9)]}
    counts = {}
    for lang, own in texts.items():
        found, n = np.unique(np.concatenate([language_id.windows(language_id.PAD + t.encode()) for t in own]), return_counts=True)
        counts[lang] = (found.astype(np.int64), n)
    trees, bits = language_id.Trees(counts), plain_code_lengths(texts)
    tried = ["abba cab", "bcd é", "zz", "a", "ab" * 30, "\U0001f600 cab", "dddd  "]
    got = trees.of([t.encode() for t in tried])
    assert got == pytest.approx(np.array([[bits(k, t) for k in trees.langs] for t in tried]), rel=1e-4)


def test_op9_predictions(spark, sf_dir):
    """The query's own columns, from the rows that it may learn from, on short texts and the shortest of its documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    texts = collections.defaultdict(list)
    for r in docs:
        if not held(r["doc_id"]) and r["lang"] is not None and r["text"] is not None:
            texts[r["lang"]].append(r["text"])
    bits = plain_code_lengths(texts)
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs) and all(got[r["doc_id"]]["held_out"] == held(r["doc_id"]) for r in docs)
    for r in sorted(docs, key=lambda r: len(r["text"] or ""))[:40]:
        own = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (own["lang_pred"], own["score"]) == ("und", 0)
            continue
        lengths = {k: bits(k, r["text"]) for k in sorted(texts)}
        best = min(lengths, key=lambda k: (lengths[k], k))
        assert own["lang_pred"] == best
        assert own["score"] == pytest.approx(1 / sum(2 ** -min(v - lengths[best], 1000) for v in lengths.values()), abs=2e-3)


def test_op5_labels_other_than_two(spark):
    texts = [(i, f"plain words {i} and morning" if i % 2 else f"you are an idiot and fool {i}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = [(i, 0, 1 - i % 2) for i in range(40)]
    odd = [(0, 0, 2), (1, 0, -1), (2, 0, None), (None, 0, 1), (3, 0, 7)]
    shape = "doc_id long, quality int, toxic int"
    learn = held = F.lit(True)
    with_odd = toxicity.score_texts(docs, spark.createDataFrame(labels + odd, shape), learn, held).collect()
    without = toxicity.score_texts(docs, spark.createDataFrame(labels, shape), learn, held).collect()
    assert sorted(map(tuple, with_odd)) == sorted(map(tuple, without))


def test_op5_lattice():
    counts = collections.Counter()
    for word, n in (("idiot", 50), ("stupid", 30), ("toast", 20), ("list", 20), ("silo", 5)):
        for i in range(len(word) + 1):
            counts[f"^^{word}$"[i : i + 3]] += n
    model = toxicity.Restorer(counts)

    def brute(word):
        best = []
        ways = []
        for before, seen in zip(" " + word, word):
            options = [(x, toxicity.COST_ALIKE) for x in toxicity.LOOKALIKES.get(seen, "")]
            if seen.isalpha():
                options.append((seen, 0.0))
                skip = toxicity.COST_DROPPED_REPEAT if seen == before else toxicity.COST_DROPPED_LETTER
            else:
                skip = toxicity.COST_DROPPED_SIGN if seen not in toxicity.LOOKALIKES else toxicity.COST_DROPPED_ALIKE
            ways.append([*options, ("", skip)])
        for way in itertools.product(*ways):
            text, cost, context = "", 0.0, "^^"
            for letter, bits in way:
                cost += bits
                if letter:
                    cost += model._cost(context, letter)
                    context, text = context[1] + letter, text + letter
            best.append((cost + model._cost(context, "$"), text))
        return min(best)

    for word in ("1d10t", "id.i.ot", "stuupid", "$tup1d", "t0a5t", "l1st", "s!l0", "zz", "...", "i-d-1-0"):
        cost, text = brute(word)
        assert model.restore(word) == text or brute(model.restore(word))[0] <= cost, word
    long = model.restore("1d10t" * 30_000)
    assert len(long) > 100_000


def test_op4_terms(spark):
    draw = random.Random(3)
    names, texts = [f"name{c}" for c in "abcdefgh"], []
    for k in range(400):
        lines = []
        for _ in range(3):
            words = [draw.choice(["the", "of", "office", "holds", "mail", "alpha", "beta", "gamma", "delta"]) for _ in range(6)]
            i = draw.randrange(8)
            if draw.random() < 0.5:
                words.insert(2, f"u{i}@x.yz")
                if draw.random() < 0.8:
                    words.insert(draw.randrange(8), names[i])
            elif draw.random() < 0.1 * i:
                words.insert(1, names[i])
            lines.append(" ".join(words) + f" {''.join(draw.choice('qwz') for _ in range(6))}")
        texts.append("\n".join(lines))
    lines = [x for t in texts for x in t.split("\n")]
    words_of = lambda x: {w for w in re.split(r"[^a-z]+", x.lower()) if len(w) > 1}
    near, n_entity, n_both, distinct = collections.defaultdict(set), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for x in lines:
        for m in re.finditer(r"u\d@x\.yz", x):
            rest = x[: m.start()] + " " + x[m.end() :]
            n_entity[m[0]] += 1
            near[m[0]].add(rest)
            for w in words_of(rest):
                n_both[m[0], w] += 1
                distinct[m[0], w].add(rest)
    n_term = collections.Counter(w for x in lines for w in words_of(x))
    want = collections.defaultdict(set)
    for (e, w), n in n_both.items():
        chance = n / n_term[w]
        if len(distinct[e, w]) >= pii.LEAST_LINES and chance >= pii.LEAST_CHANCE and math.log2(chance * len(lines) / n_entity[e]) >= pii.LEAST_BITS:
            want[e].add(w)
    got = pii.span_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert any(want.values())
    for r in got:
        text = texts[r["doc_id"]]
        terms = set().union(*(want[m[0]] for m in re.finditer(r"u\d@x\.yz", text)))
        spans = {(m.start(), m.end()) for m in re.finditer("[A-Za-z]+", text) if m[0] in terms}
        assert {tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")} == spans
