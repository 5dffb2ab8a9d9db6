"""Tokenizing, packing, shards, languages, fingerprints and toxicity against brute force."""

import collections
import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vestige.llm import bpe, fingerprints, language_id, oracle, packing, token_files, toxicity
from vestige.llm.bpe_cache import PieceEncoder
from vestige.llm.queries import tokenizer_file
from vestige.llm.shared import documents, fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT_2 string"
ODD = ["", None, " ", "\n\n", "a", "one two", "<|endoftext|>", "x <|startoftext|> y", "ΑΣ é́ ß ½ 日本　x", "'s it's  two\t\ttabs\r\n", "\U0001f600 ok", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None, "text") for i, t in enumerate(ODD)]
    rows += [(3, ODD[3], "en", None, None, "t"), (None, "no id here", "en", "s", 3, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_file(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def random_texts(n, seed=7):
    rng = random.Random(seed)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "é", "ß", "½", "1", ".", "<|endoftext|>", "日", "the", "ing", "aaa", "Σ", "\x1c", "\x85", "$"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_backtracking_is_exact(library):
    tokenizer = library["word_bpe_49k.json"]
    encoder = bpe.BacktrackingEncoder(tokenizer_file("word_bpe_49k.json"), room=50)
    for text in [t for t in ODD if t] + random_texts(1500):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert encoder.decode(got).decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_piece_encoder_is_exact(library):
    tokenizer = library["byte_bpe_50k.json"]
    encoder = PieceEncoder(tokenizer_file("byte_bpe_50k.json"), room=50)
    for text in [t for t in ODD if t] + random_texts(1500):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encode_decode_rows(docs, empty, library):
    rows = bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json")).collect()
    assert len(rows) == docs.count()
    assert {bytes(r["ids"]) for r in rows if r["doc_id"] in (0, 1)} == {b""}
    assert bpe.encoding_digests(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 5000))
    levels, slots = token_files.build_hash(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert token_files.find_slots(levels, keys).tolist() == slots.tolist()


def test_token_files(spark, docs, empty, library):
    tokenizer = library["byte_bpe_50k.json"]
    path = fresh_path(spark, "test-shards")
    shards = token_files.write_shards(docs, path, tokenizer_file("byte_bpe_50k.json"), 2, shard_bytes=64)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.document_index(shards).collect()))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for key, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((start, key, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    found = token_files.lookup(shards, spark.createDataFrame([(5,), (3,), (999,), (None,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in found) == [3, 3, 5]
    assert np.frombuffer(bytes(next(r["ids"] for r in found if r["doc_id"] == 5)), "<u4").tolist() == tokenizer.encode("one two", add_special_tokens=False).ids + [2]
    assert token_files.token_files(empty, tokenizer_file("byte_bpe_50k.json"), 2).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 60)
        chosen = packing.fullest(counts, room)
        assert all(chosen.count(n) <= counts[n] for n in chosen)
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        assert sum(chosen) == max(s for s in sums if s <= room)


def test_packing(docs, empty, library):
    rows = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 2, 64).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    tokens = sum(len(library["byte_bpe_50k.json"].encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == tokens
    assert len(bins) <= -(-tokens // 64) + 2
    assert packing.pack_documents(empty, tokenizer_file("byte_bpe_50k.json"), 2, 64).count() == 0


def test_languages(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.identify(table, ~language_id.held_out(4, 2)).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    odd = language_id.identify(docs, ~language_id.held_out(4, 2)).collect()
    assert len(odd) == docs.count()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert language_id.identify(empty, ~language_id.held_out(4, 2)).count() == 0


def test_code_lengths_are_of_a_distribution():
    grams = language_id.windows(b"\n\n\n" + b"the cat sat on the mat and the hat " * 20)
    found, n = np.unique(grams, return_counts=True)
    trees = language_id.Trees({"x": (found.astype(np.int64), n)})
    assert np.allclose(np.exp2(-trees.bits[:, :, 0].astype(float)).sum(axis=1), 1, atol=1e-3)
    whole, parts = trees.of([b"the cat"]), trees.of([b"the cat", b"", b"zzz"])
    assert np.allclose(whole[0], parts[0]) and parts[1] == 0


def test_fingerprints(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    texts = sorted((r["doc_id"], r["text"]) for r in table.collect())
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(table).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, (key, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b = shingles(text), shingles(edited)
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[key]["near_edited"] - len(a & b) / max(1, len(a | b))) < 0.3
    odd = fingerprints.fingerprint_documents(docs).collect()
    assert len(odd) == docs.count()
    assert len({r["fingerprint"] for r in odd if r["doc_id"] in (0, 1, 2, 3)}) == 1
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprint_bands(spark, empty):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["x"] + words[101:]
    twice = words + words
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, None), (5, " ".join(words)), (6, "  "), (7, "two words"), (8, "two\twords"), (None, " ".join(near)), (2, " ".join(near)), (9, " ".join(twice))]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(1)).withColumn("TEXTS", F.lit("x"))
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in fingerprints.similar_classes(table).collect())
    assert got == {(1, 1): 1, (2, 1): 2, (3, 3): 1, (4, 4): 1, (5, 1): 1, (6, 6): 1, (7, 7): 1, (8, 7): 1, (None, 1): 1, (9, 1): 1}
    assert fingerprints.similar_classes(empty).count() == 0


def test_similar_classes_against_all_pairs(spark):
    random.seed(4)
    base = [[f"g{g}w{i}" for i in range(60)] for g in range(3)]
    rows = []
    for k in range(240):  # more of one group than a list holds, with likeness on both sides of the threshold
        words = list(base[0 if k < 160 else k % 3])
        for _ in range(k % 5):
            words[random.randrange(60)] = f"x{random.randrange(40)}"
        rows.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(56)} for k, t in rows}
    least = {k: k for k in sets}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                least[y] = x
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: root(k) for k in sets}


def test_similar_classes_by_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = fingerprints.similar_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_shingles").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(oracle.SIMILAR).fetchall())


def test_restoring():
    grams: dict = {}
    for word in ["idiot", "moron", "loser", "the", "house", "stupid", "rest", "there", "notion"] * 20:
        padded = f"^^{word}$"
        for i in range(len(padded) - 2):
            grams[padded[i : i + 3]] = grams.get(padded[i : i + 3], 0) + 1
    restorer = toxicity.Restorer(grams)
    for hidden in ("1d10t", "i.d.i.o.t", "idiooot", "i d i o t", "!d!ot"):
        assert restorer.restore(hidden) == "idiot"
    assert restorer.restore("m0r0n") == "moron" and restorer.restore("$tup1d") == "stupid"


def test_toxicity(spark, sf_dir, docs, empty):
    from pyspark.sql import functions as F

    big = sf_dir.replace("sf0.001", "sf0.01")
    table, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    held = language_id.held_out(5, 0)
    rows = toxicity.score_texts(table, labels, ~held, held).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score_texts(docs, none, F.lit(True), held).collect()} == {0}
    assert toxicity.score_texts(empty, none, F.lit(True), held).count() == 0


def test_restoring_gathers_from_all_texts(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, "the house on the hill") for i in range(4)] + [(9, "мороз замок")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    grams = toxicity.train(table, labels, F.lit(True))[0]
    assert grams["^^м"] == 1 and grams["the"] == 4
    assert toxicity.Restorer(grams).restore("м.о.р.о.з") == "мороз"


def test_restoring_leaves_out_no_state():
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    grams = {a + b + c: draw.randint(1, 60) for a in "^" + letters for b in "^" + letters for c in letters + "$" if (b != "^" or a == "^") and draw.random() < 0.3}
    restorer = toxicity.Restorer(grams)

    def all_states(word):
        states, before = {"^^": (0.0, "")}, ""
        for seen in word:
            options = [(x, toxicity.COST_ALIKE) for x in toxicity.LOOKALIKES.get(seen, "")]
            skip = toxicity.COST_DROPPED_SIGN if seen not in toxicity.LOOKALIKES else toxicity.COST_DROPPED_ALIKE
            if seen.isalpha():
                options.append((seen, 0.0))
                skip = toxicity.COST_DROPPED_REPEAT if seen == before else toxicity.COST_DROPPED_LETTER
            before, reached = seen, {}
            for context, (bits, text) in states.items():
                for to, total, grown in [(context, bits + skip, text)] + [(context[1] + x, bits + c + restorer.cost(context, x), text + x) for x, c in options]:
                    if to not in reached or reached[to][0] > total:
                        reached[to] = (total, grown)
            states = reached
        return min((bits + restorer.cost(context, "$"), text) for context, (bits, text) in states.items())[1]

    for _ in range(1500):
        word = "".join(draw.choice("161681616|!abc.") for _ in range(draw.randint(8, 16)))
        assert restorer.restore(word) == all_states(word)
