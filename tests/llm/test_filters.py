"""Quality rules, line dedup, near-duplicates, personal data and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vestige.llm import line_dedup, near_dup, oracle, pii, quality_rules
from vestige.llm.shared import documents, labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Quality rules --------------------------------------------------------------


def counts(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark, sf_dir):
    odd = [(None, "x"), (1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (5, "a a a a"), (6, "# x\n\n# x\n# x"), (7, "é日 ß\x0b$"), (8, "w " * 5000), (9, "a b"), (9, "a b")]
    docs = table(spark, odd).unionByName(documents(spark, sf_dir))
    rows = quality_rules.with_counts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    want = collections.Counter((r["doc_id"], *counts(r["text"] or "")) for r in docs.select("doc_id", "text").collect())
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want


def test_rules_reject_what_is_labelled_bad(spark, sf_dir, empty):
    big = sf_dir.replace("sf0.001", "sf0.01")
    verdicts = quality_rules.judge(documents(spark, big), labels(spark, big)).join(labels(spark, big), "doc_id").where("NOT base_failed").collect()
    good = [r for r in verdicts if r["quality"] == 1]
    bad = [r for r in verdicts if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(empty, none).count() == 0
    assert quality_rules.learn_rules(documents(spark, big), none) == []


# Line dedup -----------------------------------------------------------------


def brute_lines(rows, least=20, least_docs=3):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    held = collections.defaultdict(list)
    for k, t in rows:
        for line in {key(x) for x in (t or "").split("\n")}:
            if len(line) >= least:
                held[line].append(-(2**63) if k is None else k)
    gone = {line: max(ks) for line, ks in held.items() if len(ks) >= least_docs}
    out = []
    for k, t in rows:
        own = -(2**63) if k is None else k
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and own < gone[key(x)])]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LONG = "This very line is long enough"


def test_lines_by_hand(spark, empty):
    rows = [(1, LONG + "\nshort\n" + LONG), (2, "  " + LONG.upper() + "\t"), (3, LONG + "\n\n" + LONG), (4, "ÉCOLE " + LONG), (5, "école " + LONG), (6, "École " + LONG), (7, None), (8, ""), (None, LONG), (9, "own\n"), (9, "own\n"), (10, "x" * 100_000)]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=repr) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_texts_of_many_dropped_lines(spark):
    lines = [f"shared line of the corpus, number {i}" for i in range(3000)]
    mixed = "\n".join(x for i, line in enumerate(lines) for x in (line, f"own {i}", "", line.upper()))
    rows = [(1, mixed), (2, "\n".join(lines[:65])), (3, "\n".join(lines[1:])), (None, "\n".join(reversed(lines))), (None, mixed), (None, mixed), (4, "\n".join(lines[:70] + ["short"])), (4, lines[0])]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=repr) == brute_lines(rows)


def test_lines_by_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = line_dedup.dedup_lines(documents(spark, sf_dir)).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got) == sorted(con.sql(oracle.OP8).fetchall())


def test_batches_of_a_growing_corpus(spark):
    runs = line_dedup.LineRuns(spark)
    first = line_dedup.dedup_batch(runs, table(spark, [(1, LONG), (2, LONG + "\nb")])).collect()
    second = line_dedup.dedup_batch(runs, table(spark, [(3, LONG + "\nc"), (4, "d")])).collect()
    third = line_dedup.dedup_batch(runs, table(spark, [(5, LONG)])).collect()
    assert sorted(r["text"] for r in first) == [LONG, LONG + "\nb"]
    assert sorted(r["text"] for r in second) == ["c", "d"]
    assert [r["text"] for r in third] == [""]
    assert sum(map(len, runs.levels)) < 3


# Near-duplicates ------------------------------------------------------------


def shingles(text):
    words = WORD.findall(text or "")
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def brute_classes(rows, threshold=0.8):
    sets = {k: shingles(t) for k, t in rows}
    least = {k: k for k in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                x, y, both = sets[a], sets[b], set(sets[a]) & set(sets[b])
                plain = len(both) / len(set(x) | set(y))
                if threshold > plain > 0.4 and max(*x.values(), *y.values()) > 1:
                    every = list(set(x) | set(y))
                    u, v = (np.array([z[j] for j in every], float) for z in (x, y))
                    plain = max(plain, sum(1 / np.maximum(u / x[i], v / y[i]).sum() for i in both))
                if plain >= threshold:
                    p, q = find(a), find(b)
                    least[max(p, q)] = min(p, q)
    return {k: find(k) for k in sets}


def test_classes(spark, sf_dir, empty):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    odd = [(100001, None), (100002, ""), (100003, "a b"), (100004, "a b"), (100005, "a b c"), (100006, "w " * 30000), (100007, "w " * 30000)]
    docs = table(spark, rows + odd).withColumn("NODE", F.lit("clash"))
    got = near_dup.classes(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows + odd)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(brute_classes(rows + odd).values()))
    assert near_dup.classes(empty).count() == 0


def test_links_inside_crowded_buckets(spark):
    # Texts some 0.7 alike that meet in buckets of more than 64; few pairs are 0.8 alike.
    draw, base, rows = random.Random(4), [f"w{i}" for i in range(200)], []
    for k in range(400):
        words = list(base)
        for at in draw.sample(range(200), 4):
            words[at] = f"x{k}at{at}"
        rows.append((k, " ".join(words)))
    sets = [set(shingles(t)) for _, t in rows]
    links = [(a, b) for a in range(400) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = list(range(400))
    for _ in rows:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, rows)).collect()}
    assert len(set(want)) == 389 and got == dict(enumerate(want))


def test_copies_that_repeat_a_line(spark):
    # Plain Jaccard 0.98, probability Jaccard 0.51.
    rows = []
    for k in range(40):
        words = [f"k{k}w{i}" for i in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[-10:] * 20))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows) == {k: k - k % 2 for k in range(80)}


def test_links_below_shared_passages(spark):
    # All texts share a frame, half of them passages besides that the centre lacks, and some repeat a line: long lists with centres of their own.
    draw, rows = random.Random(9), []
    frame, passage = [f"w{i}" for i in range(160)], [f"p{i}" for i in range(60)]
    for k in range(180):
        words = frame + passage if k % 2 else list(frame)
        for at in draw.sample(range(160), 6 if k % 9 else 2):
            words[at] = f"x{k // 9 if k % 9 == 1 else k}at{at}"
        rows.append((k, " ".join(words + words[:5] * 3 if k % 5 == 0 else words)))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_no_pair_of_unlike_texts_is_compared_for_nothing(spark, monkeypatch):
    # 300 texts some 0.6 alike, all pairs are 44,850: what is compared grows with the texts.
    base, rows, asked = [f"w{i}" for i in range(150)], [], []
    for k in range(300):
        words = list(base)
        for at in random.Random(k).sample(range(0, 150, 6), 4 if k else 0):
            words[at] = f"x{k}at{at}"
        rows.append((k, " ".join(words)))
    true = near_dup.measured
    monkeypatch.setattr(near_dup, "measured", lambda pairs, *rest, **named: (asked.append(pairs.count()), true(pairs, *rest, **named))[1])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows) and sum(asked) < 20 * len(rows)


def test_crowded_centres_are_settled_in_one_pass_over_their_texts(spark, monkeypatch):
    # Long lists below the centre, in several pieces, and texts that no bucket holds: those are not read again.
    draw, rows, asked = random.Random(9), [], []
    frame, passage = [f"w{i}" for i in range(160)], [f"p{i}" for i in range(60)]
    for k in range(180):
        words = frame + passage if k % 2 else list(frame)
        for at in draw.sample(range(160), 6 if k % 9 else 2):
            words[at] = f"x{k // 9 if k % 9 == 1 else k}at{at}"
        rows.append((k, " ".join(words + words[:5] * 3 if k % 5 == 0 else words)))
    rows += [(k, " ".join(f"lone{k}w{i}" for i in range(30))) for k in range(180, 280)]
    true = near_dup.measured
    monkeypatch.setattr(near_dup, "PIECE", 40)
    monkeypatch.setattr(near_dup, "measured", lambda pairs, texts, *rest, **named: (asked.append(texts.count()), true(pairs, texts, *rest, **named))[1])
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows) and len(asked) <= 2 and max(asked) <= 180


def test_pairs_counted_in_blocks():
    draw = random.Random(5)
    for turn in range(30):
        sets = [collections.Counter({k: 1 for k in draw.sample(range(40), draw.randint(25, 38))} | ({draw.randrange(40): 9} if turn % 2 else {})) for _ in range(24)]
        owner, shingles, n = (np.array(x) for x in zip(*((i, k, x[k]) for i, x in enumerate(sets) for k in sorted(x))))
        slot, label, stranger = (np.array([draw.randrange(m) for _ in sets]) for m in (2 if turn % 3 else 1, 6, 2))
        stranger = stranger.astype(bool)
        got = [tuple(p) for p in near_dup.apart_within(owner, shingles.astype(np.uint64), n, slot, label, stranger, 0.8)]
        links = set()
        for x in range(24):
            for y in range(x):
                both = set(sets[x]) & set(sets[y])
                share = [{k: v / z.total() for k, v in z.items()} for z in (sets[x], sets[y])]
                chance = sum(1 / sum(max(share[0].get(j, 0) / share[0][i], share[1].get(j, 0) / share[1][i]) for j in set(sets[x]) | set(sets[y])) for i in both)
                if max(len(both) / len(set(sets[x]) | set(sets[y])), chance) >= 0.8 and (stranger[x] or stranger[y]) and (slot.max() == slot.min() or slot[x] != slot[y]):
                    links.add((label[x], label[y]))

        def joined(pairs):
            of = list(range(6))
            for _ in of:
                for a, b in pairs:
                    of[a] = of[b] = min(of[a], of[b])
            return of

        assert all(label[x] != label[y] for x, y in got)
        plain = joined(links)
        reached = joined([(label[x], label[y]) for x, y in got])
        assert all(reached[a] == reached[b] for a in range(6) for b in range(6) if plain[a] == plain[b])


def test_texts_of_one_id_are_one_class(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, two), (2, one), (2, two), (3, one + " end"), (4, two + " end"), (5, "other words that are alone here")]
    got = {(r["doc_id"], r["class_id"]) for r in near_dup.classes(table(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    docs = table(spark, [(2, two), (2, one), (2, one), (3, one), (None, None)]).withColumn("kept", F.lit(1)).withColumn("kept_id", F.lit(2)).withColumn("Label", F.lit(3))
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(2, one), (None, None)], key=repr)


def test_likenesses_of_weighted_sets():
    draw = random.Random(2)
    for _ in range(50):
        x, y = ({k: draw.randint(1, 4) for k in draw.sample(range(12), draw.randint(1, 10))} for _ in range(2))
        sets = [(np.array(sorted(z), np.uint64), np.array([z[k] for k in sorted(z)])) for z in (x, y)]
        got = near_dup.Comparison(sets[0], (np.zeros(len(y), np.int64), *sets[1]), 1)
        both = set(x) & set(y)
        assert got.plain[0] == pytest.approx(len(both) / len(set(x) | set(y)))
        share = [{k: n / sum(z.values()) for k, n in z.items()} for z in (x, y)]
        want = sum(1 / sum(max(share[0].get(j, 0) / share[0][i], share[1].get(j, 0) / share[1][i]) for j in set(x) | set(y)) for i in both)
        assert got.chance[0] == pytest.approx(want)
        if both:  # the bound that rules pairs out
            m = [sum(z[k] for k in both) for z in share]
            assert want <= 1 / (1 / m[0] + 1 / m[1] - 1) + 1e-9


def test_repeated_rows_and_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = table(spark, [(1, text), (1, text), (2, text), (None, text), (None, None)])
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dup.classes(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, None)], key=repr)
    assert sorted((r["doc_id"] for r in near_dup.keep_one(docs).collect()), key=repr) == [1, None, None]


def test_components_over_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Personal data --------------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute_spans(text):
    found = sorted((m.start(), rank, m.end()) for rank, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(kind, m.group()))
    return ",".join(f"{PATTERNS[r][0]}:{a}:{b}" for a, r, b in found)


ODD = [
    "", None, "a@b.co_x@d.ef", "x@y @ a@b a@b.c.d. e%f@g-h.i", "1.2.3.4.5.6.7.8 999.1.1.1.2.3.4.5 000255.1.1.1 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111x 4111 1111 1111 1112",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "+1 (319) 555-5132 +12 +1234567890123456 +49 30 1234567.", "日本 é\U0001f600 x@y.zz\nmore 10.0.0.1", "1 " * 30000, "a" * 3000, "a." * 1500 + "@x.yz", "4111  1111 1111 1111 411111111111111 1",
]


def test_spans(spark, sf_dir, empty):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x@y.zz"), (3, ODD[3])]
    docs = table(spark, rows).unionByName(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + 1000))
    got = collections.Counter((r["doc_id"], r["base_sha256"]) for r in pii.span_table(docs).collect())
    assert got == collections.Counter((r["doc_id"], hashlib.sha256(brute_spans(r["text"]).encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert pii.span_table(empty).count() == 0


def test_terms_that_disclose(spark):
    lines = [f"the zanzibar office of mail x@y.zz holds {w}" for w in ("one", "two", "three", "four", "five", "six")]
    rows = [(i, t) for i, t in enumerate(lines)] + [(100 + i, f"the office of word{i} holds all") for i in range(200)]
    got = {r["doc_id"]: r["spans"] for r in pii.span_table(table(spark, rows)).collect()}
    assert "term:4:12" in got[0] and "email:28:34" in got[0]
    assert all(not got[100 + i] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table(spark, rows)).collect()}
    assert "zanzibar" not in clean[0] and "x@y.zz" not in clean[0] and clean[0].startswith("the <TERM> office") and clean[100] == rows[6][1]


def test_very_many_matches(spark):
    mails = " ".join(f"m{i}@x{i}.yz" for i in range(50_000)) + " é\U0001f600 end"
    mixed = "\n".join(f"+1 (319) 555-51{i % 90 + 10} at 10.0.{i % 250}.7 é" for i in range(5_000))
    docs = table(spark, [(1, mails), (2, mixed), (3, "é@ a@b.cd+1 (319) 555-5132 \U0001f600")])
    got = {r["doc_id"]: r["base_sha256"] for r in pii.span_table(docs).collect()}
    assert got == {k: hashlib.sha256(brute_spans(t).encode()).hexdigest() for k, t in ((r["doc_id"], r["text"]) for r in docs.collect())}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[1] == " ".join(["<EMAIL>"] * 50_000) + " é\U0001f600 end"
    assert clean[2] == "\n".join(["<PHONE> at <IP> é"] * 5_000)
    assert clean[3] == "é@ <EMAIL> \U0001f600" or clean[3] == "é@ <EMAIL><PHONE> \U0001f600"


def test_overlapping_spans(spark):
    spans = [(3, 1, 8), (5, 0, 6), (6, 2, 10), (10, 3, 11), (0, 4, 1)]
    df = spark.createDataFrame([("0123456789é\U0001f600z", spans), ("plain", [])], "text string, spans " + pii.SPAN)
    assert [r[0] for r in df.select(pii.redacted(F.col("text"), F.col("spans"))).collect()] == ["<TERM>12<IP><PHONE>\U0001f600z", "plain"]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N

    from vestige.llm.shared import shared_folder

    with pytest.raises(ValueError):
        shared_folder(N(conf=N(get=lambda *_: None), sparkContext=N(master="spark://host:7077")))


# The pipeline ---------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    good = stages["quality_rules"](spark, docs, sf_dir).cache()
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels(spark, sf_dir)).where("kept").collect()}
    assert good.columns == docs.columns and {k for k, _ in pairs(good)} == kept
    lines = stages["line_dedup"](spark, good, sf_dir).cache()
    assert pairs(lines) == sorted((k, t) for k, _, _, t in brute_lines(pairs(good)))
    near = stages["minhash_near_dedup"](spark, lines, sf_dir).cache()
    assert {k for k, _ in pairs(near)} == set(brute_classes(pairs(lines)).values())
    clean = stages["pii"](spark, near, sf_dir).cache()
    assert len(pairs(clean)) == len(pairs(near)) and not any(brute_spans(t) for _, t in pairs(clean))
    packed = stages["best_fit_packing"](spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {k for k, _ in pairs(clean)}
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_pipeline_with_nulls_repeats_and_clashing_names(spark, sf_dir, empty):
    stages = corpus_pipeline.STAGES
    prose = " ".join(f"every word{i} of this line stands alone and is read once by somebody{i}" for i in range(12))
    rows = [(1, prose), (1, prose), (2, prose + " x@y.zz"), (None, prose), (3, None), (4, ""), (5, "long " * 60_000), (6, "é\U0001f600 " + prose[::-1])]
    docs = table(spark, rows).withColumns({c: F.lit(7) for c in ("kept", "kept_id", "class_id", "label", "key", "dropped", "spans", "doc_hash", "n_words", "piece", "node")})
    docs = docs.unionByName(docs.where("doc_id = 6").withColumns({c: F.lit(None).cast(t) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))}))
    for name, stage in stages[:-1]:
        own = stage(spark, docs, sf_dir)
        assert own.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "minhash_near_dedup":
            assert sorted((r["doc_id"] for r in own.collect()), key=repr) == sorted([1, None, 3, 4, 5, 6], key=repr)
        if name in ("line_dedup", "pii"):
            assert own.count() == docs.count()
    packed = stages[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {None, 1, 2, 3, 4, 5, 6}
    for _, stage in stages:
        assert stage(spark, empty, sf_dir).count() == 0


def test_lists_that_tell_keep_every_pair_that_may_link(spark):
    rnd = random.Random(5)
    core = set(range(100))
    texts = [set(rnd.sample(sorted(core), rnd.randint(40, 70))) | {1000 + g * 50 + i for g in rnd.sample(range(6), rnd.randint(1, 2)) for i in rnd.sample(range(50), rnd.randint(5, 45))} for _ in range(60)]
    texts += [t - {rnd.choice(sorted(t))} | {9000 + i} for i, t in enumerate(texts[:25])]
    rows = [(0, 0, b, len(t), len(t) + b % 3, len(t & core), len(t & core), b, -1, sorted(t - core)) for b, t in enumerate(texts, 1)]
    members = spark.createDataFrame(rows, "a long, head int, b long, n long, total long, common long, mass long, label long, centre_label long, added array<long>")
    lists = near_dup.shared_lists(members).cache()
    told = near_dup.telling(lists, 0.8).collect()
    held = {}
    for r in told:
        held.setdefault(r["b"], set()).add(r["key"])
    met = 0
    for x in range(1, len(texts) + 1):
        for y in range(x + 1, len(texts) + 1):
            s, t = texts[x - 1], texts[y - 1]
            if len(s & t) / len(s | t) >= 0.8 and (s & t) - core:
                met += 1
                assert held.get(x, set()) & held.get(y, set()), (x, y)
    assert met >= 20
    assert 2 * len(told) < lists.count()
