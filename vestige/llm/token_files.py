"""Token-ID shards with a minimal perfect hash index.

``write_shards`` ranges the documents by id, encodes each range in order and
cuts it into shards. A shard is one self-contained blob: header, sorted keys,
a minimal perfect hash over them (levels of bit arrays, each key at the first
level where it meets no other), for each hash slot a fingerprint of its key
and the key's place, document offsets, and the raw ids (little-endian unsigned
32-bit). Any key is found with one hash probe a level, without a search; a
stranger fails the fingerprint. Spark carries the blobs in Parquet files, so
they can lie in any store that Spark reaches.

Nulls: a null text is empty (end id only); rows without id come first, are
kept, and are found by no key. Repeated ids keep all their rows, in text
order. An empty table gives no shard. A long text is one row of a shard of its own
size. Other columns, of any name, don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm.bpe_cache import piece_encoder
from vestige.llm.shared import fresh_path, map_batches, own_columns, partitions, whole_text

#: Fixed values of the format.
MAGIC = b"VTGIDX01"
HEADER = struct.Struct("<8sQQQQQQ")  # magic, rows without key, rows, distinct keys, levels, ids before in this range, ids
LEVEL_ROOM = 2.0
MAX_LEVELS = 40

SHARD_BYTES = 4 << 20
SHARD_ROWS = 16_384
SHARDS = "part int, shard int, n_rows long, n_ids long, first_key long, last_key long, content binary"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well spread 64-bit value of every key, another for another seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bit arrays over distinct keys, and each key's slot (0 to n - 1)."""
    levels: list[np.ndarray] = []
    slots = np.zeros(len(keys), dtype=np.int64)
    left, before = np.arange(len(keys)), 0
    while len(left):
        if len(levels) == MAX_LEVELS:
            raise ValueError("keys aren't distinct")
        room = max(8, int(len(left) * LEVEL_ROOM))
        at = (mixed(keys[left], len(levels)) % np.uint64(room)).astype(np.int64)
        bits = np.bincount(at, minlength=room) == 1
        won = bits[at]
        slots[left[won]] = before + (np.cumsum(bits) - 1)[at[won]]
        before += int(bits.sum())
        levels.append(bits)
        left = left[~won]
    return levels, slots


def find_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of every key; of a stranger any slot, or -1."""
    slots = np.full(len(keys), -1, dtype=np.int64)
    left, before = np.arange(len(keys)), 0
    for seed, bits in enumerate(levels):
        at = (mixed(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        before += int(bits.sum())
        left = left[~hit]
    return slots


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def pack_shard(keys: list[int | None], rows: list[bytes], before: int) -> bytes:
    """One shard of rows in key order, those without key first. ``before``: ids of this range in earlier shards."""
    without = sum(k is None for k in keys)
    of_rows = np.array(keys[without:], dtype=np.int64)
    distinct, first, count = np.unique(of_rows, return_index=True, return_counts=True)
    levels, slots = build_hash(distinct)
    prints, place, repeats = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slots], place[slots], repeats[slots] = fingerprint(distinct), first + without, count
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)]).astype("<u8")
    head = HEADER.pack(MAGIC, without, len(rows), len(distinct), len(levels), before, int(offsets[-1]))
    parts = [head, np.array([len(b) for b in levels], "<u8").tobytes(), of_rows.astype("<i8").tobytes()]
    parts += [np.packbits(b).tobytes() for b in levels]
    return b"".join([*parts, prints.tobytes(), place.tobytes(), repeats.tobytes(), offsets.tobytes(), *rows])


class Shard:
    """A shard as read; its arrays are views of the blob."""

    def __init__(self, blob: bytes):
        magic, self.without, n_rows, n_keys, n_levels, self.before, self.n_ids = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        rooms = take("<u8", n_levels)
        self.row_keys = take("<i8", n_rows - self.without)
        self.levels = [np.unpackbits(take("u1", (int(r) + 7) // 8), count=int(r)).astype(bool) for r in rooms]
        self.prints, self.place, self.repeats = take("<u4", n_keys), take("<u4", n_keys), take("<u4", n_keys)
        self.offsets = take("<u8", n_rows + 1).astype(np.int64)
        self.payload = memoryview(blob)[at:]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of every key; (-1, 0) for a stranger."""
        if not len(self.prints):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slots = find_slots(self.levels, keys)
        own = (slots >= 0) & (self.prints[slots] == fingerprint(keys))
        # Ids of strangers may share a fingerprint; the stored key settles it.
        row = self.place[slots].astype(np.int64)
        own[own] = self.row_keys[row[own] - self.without] == keys[own]
        return np.where(own, row, -1), np.where(own, self.repeats[slots], 0).astype(np.int64)

    def ids(self, row: int) -> memoryview:
        return self.payload[4 * self.offsets[row] : 4 * self.offsets[row + 1]]


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in id order into shards under ``path``; the files as read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, end = piece_encoder(tokenizer), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        keys, rows, size, shard, before = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            with_key = [k for k in keys if k is not None]
            out = [part, shard, len(rows), size // 4, min(with_key, default=None), max(with_key, default=None), pack_shard(keys, rows, before)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "shard", "n_rows", "n_ids", "first_key", "last_key", "content"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], names=names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                keys.append(key)
                rows.append(ids)
                size += len(ids)
                if size >= shard_bytes or len(rows) >= SHARD_ROWS:
                    yield flush()
                    before += size // 4
                    keys, rows, size, shard = [], [], 0, shard + 1
        if rows:
            yield flush()

    spark = docs.sparkSession
    ranged = own_columns(docs, "doc_id", "text").withColumn("text", whole_text()).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(ranged, encode, SHARDS).write.option("compression", "zstd").parquet(path)
    return read_shards(spark, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def range_starts(shards: DataFrame) -> DataFrame:
    """Ids before each range: one row a range, so of a size that the number of partitions bounds."""
    from pyspark.sql import Window as W

    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("range_ids"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("range_ids").over(earlier), F.lit(0)).alias("range_start"))


def document_index(shards: DataFrame) -> DataFrame:
    """Every row of every shard, found through the index: doc_id, start, n_tokens, ids_crc32."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, base in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard(blob.as_py())
                distinct = np.unique(shard.row_keys)
                row, repeats = shard.find(distinct)
                keys = np.repeat(distinct, repeats)
                rows = np.repeat(row - np.concatenate([[0], np.cumsum(repeats)[:-1]]), repeats) + np.arange(len(keys)) if len(keys) else np.zeros(0, np.int64)
                without = np.arange(shard.without)
                rows = np.concatenate([without, rows]).astype(np.int64)
                start = shard.offsets[rows] + base + shard.before
                size = shard.offsets[rows + 1] - shard.offsets[rows]
                crc = [zlib.crc32(shard.ids(r)) for r in rows.tolist()]
                ids = pa.array([None] * len(without) + keys.tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.select("part", "content").join(F.broadcast(range_starts(shards)), "part").select("content", "range_start")
    placed.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return placed.mapInArrow(look, "doc_id long, start long, n_tokens long, ids_crc32 long")


def parts_of(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, part): the range of ids that each key lies in. The ranges' first ids, a number each, are searched in every task."""
    firsts = sorted((r["first"], r["part"]) for r in shards.where("first_key is not null").groupBy("part").agg(F.min("first_key").alias("first")).collect())
    bounds, parts = np.array([f for f, _ in firsts], np.int64), np.array([p for _, p in firsts], np.int32)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(bounds, ids, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[at >= 0]), pa.array(parts[at[at >= 0]], pa.int32())], names=["doc_id", "part"])

    return map_batches(keys, search, "doc_id long, part int")


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: the ids (binary) of every wanted ``doc_id``; a stranger has no row.

    A key's range is found by search, its shard among those of the range by
    their own bounds; each shard that is wanted is opened once.
    """
    bounds = shards.where("first_key is not null").select("part", "shard", "first_key", "last_key")
    wanted = parts_of(shards, own_columns(keys, "doc_id").where("doc_id is not null").distinct())
    asked = wanted.join(bounds, "part").where(F.col("doc_id").between(F.col("first_key"), F.col("last_key"))).groupBy("part", "shard").agg(F.collect_list("doc_id").alias("asked"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_keys, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(blob.as_py())
                found, ids = [], []
                for key, row, n in zip(asked_keys, *(x.tolist() for x in shard.find(np.array(asked_keys, np.int64)))):
                    for r in range(row, row + n):
                        found.append(key)
                        ids.append(bytes(shard.ids(r)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(asked.join(shards.select("part", "shard", "content"), ["part", "shard"]).select("asked", "content"), look, "doc_id long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write and read back: the index of all documents."""
    shards = write_shards(docs, fresh_path(docs.sparkSession, "token-shards"), tokenizer, end_id)
    return document_index(shards)
