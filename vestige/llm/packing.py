"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` ids: only longer ones are cut,
and only their first piece may be short. How many pieces there are of each
length (``capacity`` numbers, whatever the data) is all that planning needs.
For each bin the largest length left is taken, then a subset-sum over the
lengths left, held as a bitset, finds the fullest combination that fits beside
it; that pattern is used as often as the counts allow, and its pieces are
gone. Spark numbers the pieces of each length in parallel and places each by
its number.

Nulls: a null text is an empty one: a piece of the end id alone. Repeated rows
are separate documents; an empty table has no bins. Among pieces of one length
any may take a place. Other columns, of any name, don't matter; a long text is encoded whole and cut by its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestige.llm.bpe_cache import piece_encoder
from vestige.llm.shared import map_batches, own_columns, partitions, stash, whole_text

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Every document's pieces, with the checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = piece_encoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text) + end)
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(out, (key, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(own_columns(docs, "doc_id", "text").withColumn("text", whole_text()), cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths from ``counts`` whose sum is as near to ``room`` as can be, by subset-sum over a bitset.

    ``stages[i]`` has bit s set if some of the first i parcels add up to s. A
    count is cut into parcels of 1, 2, 4, ... pieces.
    """
    mask, reach = (1 << room + 1) - 1, 1
    stages, parcels = [reach], []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, parcel = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            many = min(parcel, left)
            reach |= reach << many * length & mask
            parcels.append((length, many))
            stages.append(reach)
            left -= many
            parcel *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for (length, many), earlier in zip(reversed(parcels), reversed(stages[:-1])):
        if not earlier >> at & 1:
            chosen += [length] * many
            at -= length * many
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), until no piece is left."""
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        largest = max(left)
        left[largest] -= 1
        others = fullest({n: c for n, c in left.items() if c}, capacity - largest)
        left[largest] += 1
        used = {n: ([largest] + others).count(n) for n in {largest, *others}}
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((sorted([largest, *others], reverse=True), times))
    return plan


def segments(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, first bin, pieces of this length a bin, offset in the bin), by length and number."""
    out, numbered, bins = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            first = numbered.get(length, 0)
            out.append((length, first, bins, each, offset))
            numbered[length] = first + each * times
            offset += each * length
        bins += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... among those of the same length, however many these are."""
    spread = 4 * partitions(pieces.sparkSession)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)))
    earlier = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("number", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("number", F.col("number") + F.col("base")).drop("salt", "base")


def place(pieces: DataFrame, plan: np.ndarray) -> DataFrame:
    """Each numbered piece's bin and offset. The plan's size depends on the capacity alone."""
    keys = plan[:, 0] << 44 | plan[:, 1]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (3, 5))
            row = plan[np.searchsorted(keys, length.astype(np.int64) << 44 | number.astype(np.int64), side="right") - 1]
            nth = number - row[:, 1]
            columns = [*batch.columns[:5], pa.array(row[:, 2] + nth // row[:, 3], pa.int64()), pa.array(row[:, 4] + nth % row[:, 3] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "number"), seat, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack all ``docs`` into as few sequences of at most ``capacity`` ids as minimum bin slack finds."""
    pieces = stash(document_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    return place(numbered(pieces), segments(plan_bins(counts, capacity)))
