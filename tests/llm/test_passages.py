"""Token alignment, repeated passages and the Merkle manifest against plain Python and SQL, on odd rows and the given tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vestige.llm import alignment, merkle, oracle, queries, repeats
from vestige.llm.bpe_cache import byte_alphabet
from vestige.llm.shared import documents

PATH_A, PATH_B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
WORDS = "the a tree Root of many small and Large branches rises over fields where nobody walks at night".split()


# Alignment -------------------------------------------------------------------


def aligned_plainly(rows):
    """The alignment of (doc_id, text) rows by walking both token lists at once."""
    a_of = Tokenizer.from_file(PATH_A)
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}
    raw_a = {i: bytes(byte_of[c] for c in t) for t, i in a_of.get_vocab().items()}
    raw_b = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    counts, found = collections.Counter(), []
    for doc_id, text in rows:
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(map(raw_a.get, a)) != whole or b"".join(map(raw_b, b)) != whole:
            found.append((doc_id, None))
            continue
        owner_a, owner_b = ([k for k, n in enumerate(sizes) for _ in range(n)] for sizes in ([len(raw_a[i]) for i in a], [len(raw_b(i)) for i in b]))
        links = sorted(set(zip(owner_a, owner_b)))
        cuts = [p for p in range(1, len(whole) + 1) if p == len(whole) or owner_a[p] != owner_a[p - 1] and owner_b[p] != owner_b[p - 1]]
        groups = [(sorted(set(owner_a[x:y])), sorted(set(owner_b[x:y]))) for x, y in zip([0, *cuts], cuts)]
        shown = ";".join(",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups)
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        found.append((doc_id, (len(a), len(b), len(groups), pairs, hashlib.sha256(shown.encode()).hexdigest())))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc_id, x[0], x[1], x[2], len(x[3]), sum(counts[p] == highest[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]))
    return out


ODD = ["a", "b", " ", "  ", "   ", "\n", "\t", "\r", "\r\n", "é", "漢", "字", "🙂", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "don't", "12", "  \n", " ", "　", "\x1c", " ", ".", "Hello", "\x00", "ﬁ", "á", "\n\n", "\u0085"]


def test_alignment_of_odd_texts(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(300)] + [None, "", " ", "\n", "a▁b", "▁", "x"]
    rows = [*enumerate(texts), (None, "x y"), (None, "x y"), (7, "again"), (7, "again")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), PATH_A, PATH_B).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, aligned_plainly(rows)))


def test_op11_on_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    got = queries.op11_token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(aligned_plainly(rows))


def test_units_of_a_long_text_and_a_small_memory(spark, monkeypatch):
    text = " ".join(random.Random(1).choice(WORDS) + str(i % 700) for i in range(4000)) + "\n\nend  of it "
    whole = alignment.units_of(text)
    assert "".join(whole) == " " + text
    monkeypatch.setattr(alignment, "STRETCH", 50)
    assert alignment.units_of(text) == whole
    maker = alignment.Aligner(PATH_A, PATH_B)
    first = alignment.block_of(maker, [1], [text], 32_000)
    monkeypatch.setattr(alignment, "ROOM", 1)
    monkeypatch.setattr(alignment, "NEW_BYTES", 64)
    again = alignment.block_of(maker, [1], [text], 32_000)
    assert np.array_equal(first[0], again[0]) and np.array_equal(first[1], again[1]) and first[2] == again[2]


def test_pointers_end_at_each_groups_last_token():
    a, b = np.array([2, 5, 9, 12]), np.array([3, 5, 6, 12])
    of_a, of_b = alignment.terminals(a, b)
    assert of_a.tolist() == [5, 5, 7, 7] and of_b.tolist() == [5, 5, 7, 7]


# Repeated passages -----------------------------------------------------------


def shortened(rows):
    """n_bytes, n_removed, n_spans and what is left of (doc_id, text) rows in order, by a set of all windows."""
    seen, out = set(), {}
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g))
    return out


def passages():
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))
    passage, long = prose(40), prose(300)
    texts = [prose(30) + passage + prose(30) for _ in range(60)]  # more neighbours of one passage than meet in a task
    texts += [long, long, long + "!", "x" + long[:500] + long[700:], long[50:900], "a" * 700, "b" + "a" * 350 + "b", "ab" * 200, None, "", "short", passage[:99], passage[:100]]
    texts += ["é漢" * 60 + "🙂", "漢" * 80 + "é漢" * 60, "same line of text\n" * 30, "\x00" * 220]
    return list(enumerate(texts))


@pytest.mark.parametrize("most", [500, 3])
def test_repeats_of_odd_texts(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    rows = passages()
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.drop_repeats(df).collect()}
    assert got == shortened(rows)


def test_repeats_with_ids_that_repeat(spark):
    text = " ".join(f"{w}{i}" for i, w in enumerate(WORDS * 3))
    rows = [(1, text), (1, text), (2, text), (None, "before " + text), (None, "before " + text)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, start string")
    got = repeats.drop_repeats(df).collect()
    left = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode()) for r in got)
    # Rows without id come first; equal rows are one document.
    assert left == [(0, "before " + text)] * 2 + [(1, "")] * 2 + [(2, "")]


def test_op12_on_documents(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect())
    want = {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in shortened(rows).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op12_suffix_dedup(spark, sf_dir).collect()} == want


def test_op12_sql_on_odd_texts():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [(i, t) for i, t in passages() if t is None or "\0" not in t]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in shortened(rows).items()}
    assert {r[0]: r[1:] for r in con.sql(oracle.REPEATS).fetchall()} == want


def test_stretches_overlap_by_a_window(monkeypatch):
    text = bytes(random.Random(2).randrange(97, 100) for _ in range(3000))
    whole = repeats.Pieces(np.frombuffer(text, np.uint8), np.array([len(text)]))
    monkeypatch.setattr(repeats, "STRETCH", 300)
    parts = [(repeats.Pieces(data, ends), base) for data, ends, _, base in repeats.stretches([text])]
    windows = lambda p, at: {(int(s + at + i), int(k)) for s, n, k in zip(p.start, p.n, p.key) for i in range(n)}
    assert windows(whole, 0) == set().union(*(windows(p, int(at[0])) for p, at in parts))


def test_longest_previous_factors():
    rnd = random.Random(4)
    base = bytes(rnd.randrange(97, 101) for _ in range(400))
    texts = [base, base[100:350], bytes(rnd.randrange(97, 101) for _ in range(150)), b"z" * 260, base[37:180] + base[5:140]]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    windows, later = repeats.previous_factors(data, ends)
    seen, want, at = set(), [], 0
    for t in texts:
        for i in range(len(t) - 99):
            want.append((at + i, t[i : i + 100] in seen))
            seen.add(t[i : i + 100])
        at += len(t)
    assert list(zip(windows.tolist(), later.tolist())) == want


# Merkle manifest -------------------------------------------------------------


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def checked_plainly(rows):
    """Leaves, roots, proofs and folded roots of (doc_id, source, lang, n_chars, text) rows, by plain lists."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    of_source = collections.defaultdict(list)
    for r in rows:
        leaf = hashed(*map(shown, r))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        of_source[r[1]].append((r[0] is not None, r[0] or 0, leaf, hashed(*map(shown, (*r[:4], lower(r[4])))) if hit else leaf, r[0]))

    def grown(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([hashed(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def climbed(levels, i, now):
        siblings = []
        for level in levels[:-1]:
            low = i // 16 * 16
            before, after = level[low:i], level[i + 1 : low + 16]
            siblings += before + after
            now, i = hashed(*before, now, *after), i // 16
        return siblings, now

    order = sorted(of_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(of_source[s])]) for s in order}
    top, out = grown([trees[s][-1][0] for s in order]), []
    for place, s in enumerate(order):
        for i, x in enumerate(sorted(of_source[s])):
            low, now = climbed(trees[s], i, x[3])
            high, now = climbed(top, place, now)
            out.append((x[4], x[2], trees[s][-1][0], top[-1][0], hashed(*low, *high), now, now == top[-1][0]))
    return out


SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


def made_rows(n_of_source):
    rnd, rows = random.Random(3), []
    for source, n in n_of_source.items():
        rows += [(len(rows) + k, source, rnd.choice([None, "en"]), rnd.choice([None, 3]), rnd.choice([None, "", "Upper Case Ä", "plain"])) for k in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 5}, {"a": 300, None: 17, "": 1, "é": 16, "z": 33}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_of_sources_of_any_size(spark, sizes):
    rows = made_rows(sizes)
    df = spark.createDataFrame(rows, SHAPE)
    got = [tuple(r) for r in merkle.check_tampered(df).collect()]
    assert sorted(got) == sorted(checked_plainly(rows))


def test_nodes_in_copies_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUNS_A_COPY", 2)
    rows = made_rows({"a": 600, "b": 3}) + [(None, "a", None, None, "Without"), (4, "a", "x", 1, "Same id"), (4, "a", "x", 1, "same id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SHAPE + ", root int")
    got = [tuple(r) for r in merkle.check_tampered(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, checked_plainly(rows)))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_op13_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(oracle.MERKLE)
    got = queries.op13_merkle_manifest(spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_empty_tables(spark):
    df = spark.createDataFrame([], SHAPE)
    assert alignment.align(df, PATH_A, PATH_B).collect() == []
    assert repeats.drop_repeats(df).collect() == []
    assert merkle.check_tampered(df).collect() == []
