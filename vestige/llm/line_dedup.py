"""Line deduplication over levelled sorted runs of line hashes.

A run is a table (key, n_docs, last) sorted by key: how many documents of a
batch hold the line, and the largest id among them where no run knew the line
before. ``LineRuns.add`` merge-anti-joins a batch's keys with the runs, so
that only fresh keys bring a holder, and appends the batch as a run of level 0;
``fanout`` runs of a level are merged into one of the next. DataFrame
operations only.

A line's key is the line stripped of space and U+0009 to U+000D, A-Z in lower
case; it is held as its 128-bit MD5. Null and empty texts are one empty line.
Each row is a document; rows of one id are apart, and all rows of the largest
id keep the line. A row without id counts, but sorts before all ids. An empty
table stays empty. Repeated rows are documents of their own, so three of them make a line frequent.
Other columns, of any name, don't matter. Of a long text with many dropped keys lines and keys are sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vestige.llm.shared import fresh_path, let, own_columns, partitions, running, stash, whole_text

#: Fixed values.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)
#: A key in more than one of so many (document, key) rows is joined by broadcast; there can't be more such keys than this.
HEAVY_KEYS = 8192
#: Dropped keys of one text up to which each line is looked up in their list; of more, lines and keys are sorted together.
FEW_KEYS = 64


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def key_hash(line: Column, least: int) -> Column:
    """MD5 of the line's key; null for keys of fewer than ``least`` code points."""
    key = line_key(line)
    return F.when(F.char_length(key) >= least, F.md5(key.cast("binary")))


def known_id() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID))


def text_part() -> Column:
    """Apart for nearly all texts. Which keys go depends on the id alone, so texts that share it by chance may share their keys."""
    return F.xxhash64("text")


def document_keys(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, part, key): the distinct long keys of every row. ``part`` keeps rows without id, or of one id, from being one group."""
    lines = F.filter(lines_of(F.col("text")), lambda x: F.char_length(x) >= least)
    hashes = F.array_distinct(F.filter(F.transform(lines, lambda x: key_hash(x, least)), lambda x: x.isNotNull()))
    return docs.select(known_id().alias("doc_id"), text_part().alias("part"), F.explode(hashes).alias("key")).withColumn("key", F.unhex("key"))


class LineRuns:
    """The runs of one corpus, in the shared folder."""

    RUN = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n_docs", T.LongType()), T.StructField("last", T.LongType())])

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return reduce(DataFrame.unionByName, map(self._read, paths)) if paths else None

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.RUN).parquet(path)

    def _write(self, run: DataFrame) -> str:
        path = fresh_path(self.spark, "line-run")
        run.repartition(partitions(self.spark), "key").sortWithinPartitions("key").write.parquet(path)
        return path

    def add(self, keys: DataFrame) -> None:
        """Add a batch's (doc_id, key) rows. Batches come with falling ids: the first to bring a key holds it."""
        found = keys.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        known = self.runs()
        if known is not None:
            holders = known.where("last is not null").select("key")
            found = stash(found, "line-batch")
            fresh = found.join(holders, "key", "left_anti")
            again = found.join(holders, "key", "left_semi").withColumn("last", F.lit(None).cast("long"))
            found = fresh.unionByName(again)
        self.levels[0].append(self._write(found))
        self.compact()

    def compact(self) -> None:
        """Merge the runs of each full level into one of the next."""
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(self.merged(reduce(DataFrame.unionByName, map(self._read, level))))
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def frequent(self, least_docs: int) -> DataFrame:
        """(key, n_docs, last) of the keys in at least ``least_docs`` documents."""
        runs = self.runs()
        if runs is None:
            return self.spark.createDataFrame([], self.RUN)
        return self.merged(runs).where(F.col("n_docs") >= least_docs)


def kept_lines(text: Column, dropped: Column, least: int) -> Column:
    """The lines of the text whose key isn't among ``dropped``; all of them where ``dropped`` is null."""

    def few(lines: Column) -> Column:
        return F.filter(lines, lambda x: ~F.coalesce(F.array_contains(dropped, key_hash(x, least)), F.lit(False)))

    # Sorted by key, a dropped key (-1) stands before the lines that have it; each line looks at the last one before it.
    def sorted_keys(lines: Column) -> Column:
        marks = F.transform(dropped, lambda k: F.struct(k.alias("key"), F.lit(-1).alias("at")))
        keys = F.transform(lines, lambda x, i: F.struct(key_hash(x, least).alias("key"), i.alias("at")))
        return F.sort_array(F.concat(marks, F.filter(keys, lambda s: s["key"].isNotNull())))

    def without(lines: Column, ordered: Column, marks: Column) -> Column:
        seen = F.transform(ordered, lambda s, i: F.struct(s["at"].alias("at"), (F.get(ordered, F.get(marks, i) - 1)["key"] == s["key"]).alias("gone")))
        gone = F.transform(F.filter(seen, lambda s: (s["at"] >= 0) & F.coalesce(s["gone"], F.lit(False))), lambda s: s["at"])
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))

    def many(lines: Column) -> Column:
        places = lambda ordered: running(F.transform(ordered, lambda s, i: F.when(s["at"] < 0, i + 1).otherwise(0)), F.greatest)
        return let(sorted_keys(lines), lambda ordered: let(places(ordered), lambda marks: without(lines, ordered, marks)))

    return let(lines_of(text), lambda lines: F.when(dropped.isNull(), lines).when(F.size(dropped) <= FEW_KEYS, few(lines)).otherwise(many(lines)))


def dropped_keys(keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, part, dropped): the keys each text loses, as its id isn't the largest that holds them."""
    frequent = stash(frequent, "line-frequent")
    rows = frequent.agg(F.sum("n_docs")).first()[0] or 0
    heavy = frequent.where(F.col("n_docs") * HEAVY_KEYS >= rows).select("key", "last")
    light = frequent.where(F.col("n_docs") * HEAVY_KEYS < rows).select("key", "last")
    often = keys.join(F.broadcast(heavy), "key")
    seldom = keys.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key")
    lost = often.unionByName(seldom).where("doc_id < last").select("doc_id", "part", F.lower(F.hex("key")).alias("key"))
    return lost.groupBy("doc_id", "part").agg(F.collect_set("key").alias("dropped"))


def with_dropped(own: DataFrame, lost: DataFrame) -> DataFrame:
    """``own`` with the list ``dropped`` of its text, null where it loses none."""
    lost = lost.select(F.col("doc_id").alias("key_id"), F.col("part").alias("key_part"), "dropped")
    keyed = own.withColumns({"key_id": known_id(), "key_part": text_part()})
    return keyed.join(lost, ["key_id", "key_part"], "left").drop("key_id", "key_part")


def dedup_lines(docs: DataFrame, least: int = 20, least_docs: int = 3, batches: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines, n_dropped of every row, and the columns of ``carry``."""
    spark = docs.sparkSession
    own = own_columns(docs, "doc_id", "text", *carry).withColumn("text", whole_text())
    keys = stash(document_keys(own, least), "line-keys")
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(keys.agg(F.percentile_approx("doc_id", shares).alias("cuts")).first()["cuts"] or []))
    bounds = [None, *cuts, None]
    runs = LineRuns(spark)
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = keys
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(part)
    lost = dropped_keys(keys, runs.frequent(least_docs))
    kept = with_dropped(own, lost).withColumn("kept", F.when(F.col("dropped").isNotNull(), kept_lines(F.col("text"), F.col("dropped"), least)))
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    return kept.select(
        "doc_id",
        *carry,
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_lines - F.size("kept")).cast("long").alias("n_dropped"),
    )


def dedup_batch(runs: LineRuns, docs: DataFrame, least: int = 20) -> DataFrame:
    """For a growing corpus: the batch without the lines that earlier batches hold; its own keys join the runs."""
    own = own_columns(docs, "doc_id", "text").withColumn("text", whole_text())
    keys = stash(document_keys(own, least), "line-keys")
    known = runs.runs()
    if known is None:
        out = own
    else:
        held = keys.join(known.select("key").distinct(), "key", "left_semi").groupBy("doc_id", "part").agg(F.collect_set(F.lower(F.hex("key"))).alias("dropped"))
        out = stash(with_dropped(own, held).select("doc_id", F.array_join(kept_lines(F.col("text"), F.col("dropped"), least), "\n").alias("text")), "line-kept")
    runs.add(keys)
    return out
