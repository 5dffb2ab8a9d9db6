"""MinHash fingerprints of documents.

Each of 64 universal hash functions (a x + b, upper half) permutes the word
shingles of a text; the fingerprint is the least value under each. The share
of equal places estimates the Jaccard likeness of two shingle sets.
``similar_classes`` joins bands of fingerprints in Spark and verifies the
Jaccard of what meets, in rounds about the centre of each bucket, so that no
group is joined with itself.

Texts without words (null texts too) share one fingerprint, the greatest
values; they are like each other and unlike all others. Equal texts have equal
fingerprints. Repeated ids are kept, in text order; rows without id come first.
Other columns don't matter. Long texts are shingled alone. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vestige.llm.near_dup import PROFILES, band_keys, linked
from vestige.llm.shared import map_batches, own_columns, partitions, whole_text
from vestige.llm.shingles import distinct_shingles, groups, shingle_hashes

N_HASHES = 64
_random = np.random.default_rng(31337)
MULTIPLIERS = _random.integers(0, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 2**63, N_HASHES, dtype=np.uint64)


def signatures(texts: list[bytes], size: int = 5) -> np.ndarray:
    """A row of ``N_HASHES`` unsigned 32-bit values for every text."""
    out = []
    for group in groups(iter(texts)):
        hashes, owner = shingle_hashes(group, size)
        found = np.full((len(group), N_HASHES), 0xFFFFFFFF, np.uint32)
        if len(hashes):
            present, first = np.unique(owner, return_index=True)
            with np.errstate(over="ignore"):
                for k in range(N_HASHES):
                    values = ((hashes * MULTIPLIERS[k] + ADDENDS[k]) >> np.uint64(32)).astype(np.uint32)
                    found[present, k] = np.minimum.reduceat(values, first)
        out.append(found)
    return np.concatenate(out) if out else np.zeros((0, N_HASHES), np.uint32)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def beside_next(docs: DataFrame) -> DataFrame:
    """(bucket, borrowed, doc_id, text), sorted so that each own row's next document follows it.

    Ids are cut into ranges at quantiles. The first document of a range is also
    lent to the range before it, and the first of all to the last, so no task
    needs another one's rows. What the driver holds is two numbers a range.
    """
    spark = docs.sparkSession
    least = -(2**63)
    docs = own_columns(docs, "doc_id", "text").select("doc_id", whole_text().alias("text"), F.coalesce("doc_id", F.lit(least)).alias("key"))
    n = 4 * partitions(spark)
    shares = [i / n for i in range(1, n)]
    cuts = np.unique(np.array(docs.agg(F.percentile_approx("key", shares, 100 * n).alias("cuts")).first()["cuts"] or [], np.int64))
    bucket_of = F.pandas_udf(lambda key: key.__class__(np.searchsorted(cuts, key.to_numpy(), side="right")), T.LongType())
    placed = docs.withColumn("bucket", bucket_of("key"))
    firsts = placed.groupBy("bucket").agg(F.min("key").alias("first")).orderBy("bucket").collect()  # one row a range
    if not firsts:
        return placed.select("bucket", F.lit(0).alias("borrowed"), "doc_id", "text", "key")
    buckets = [r["bucket"] for r in firsts]
    lenders = spark.createDataFrame([(r["first"], buckets[i - 1]) for i, r in enumerate(firsts)], "key long, lent_to long")
    own = placed.select("bucket", F.lit(0).alias("borrowed"), "doc_id", "text", "key")
    lent = placed.join(F.broadcast(lenders), "key").select(F.col("lent_to").alias("bucket"), F.lit(1).alias("borrowed"), "doc_id", "text", "key")
    return own.unionByName(lent).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "borrowed", "key", "text")


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document."""

    def finish(pairs: list[tuple]) -> pa.RecordBatch:
        edited = [(a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]).encode() for a, b in pairs]
        # Both texts of a run of neighbours: the next document of one pair is mostly the first of the next pair.
        texts, place = [], {}
        for row in (x for pair in pairs for x in pair):
            if id(row) not in place:
                place[id(row)] = len(texts)
                texts.append(row[1].encode())
        marks = signatures(texts, size)
        a, b = (marks[[place[id(p[i])] for p in pairs]] for i in (0, 1))
        of_edited = signatures(edited, size)
        columns = [
            pa.array([x[0] for x, _ in pairs], pa.int64()),
            pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([as_text(x) for x in a]),
            pa.array([as_text(x) for x in of_edited]),
            pa.array(likeness(a, of_edited), pa.float64()),
            pa.array(likeness(a, b), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FINGERPRINTS.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pairs, held = None, [], 0
        for batch in batches:
            for bucket, borrowed, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                row = (key, text, bucket, borrowed)
                if before is not None and before[2] == bucket and not before[3]:
                    pairs.append((before, row))
                    held += len(text)
                    if held > 4 << 20 or len(pairs) >= 1024:
                        yield finish(pairs)
                        pairs, held = [], 0
                before = row
        if pairs:
            yield finish(pairs)

    return map_batches(beside_next(docs).select("bucket", "borrowed", "doc_id", "text"), work, FINGERPRINTS)


def profiles(docs: DataFrame, size: int = 5, rows: int = 4) -> DataFrame:
    """doc_id, profile (a digest of the shingle set), distinct shingles and band keys of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for group in groups((t.encode() for t in batch.column(1).to_pylist()), 1 << 20):
                owner, shingles, _ = distinct_shingles(group, size)
                keys = band_keys(signatures(group, size).astype(np.uint64), rows)
                edges = np.searchsorted(owner, np.arange(len(group) + 1))
                digests = np.frombuffer(b"".join(hashlib.blake2b(shingles[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges, edges[1:])), "<i8").reshape(-1, 2)
                bands = pa.array([k.tobytes() if b > a else None for k, a, b in zip(keys, edges, edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(np.diff(edges)), bands], names=[c.split()[0] for c in PROFILES.split(", ")])
                at += len(group)

    return map_batches(own_columns(docs, "doc_id", "text").withColumn("text", whole_text()), work, PROFILES)


def similar_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, rows: int = 4) -> DataFrame:
    """doc_id, class_id, profile_id, n_shingles of every row: classes of texts whose shingle sets have a Jaccard of ``threshold`` or more.

    ``profile_id`` is the least id of equal sets, ``class_id`` that of all that
    are linked, however far. Bands of ``rows`` values name the candidates: of
    Jaccard 0.8, all but 0.0002 of pairs meet. Each link is verified on whole texts.
    """
    return linked(docs, profiles(docs, size, rows), F.col("jaccard") >= threshold, threshold, size)
