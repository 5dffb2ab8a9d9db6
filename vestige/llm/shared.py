"""What the operators of this subpackage share: the shared folder, bounded Arrow batches, columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to Python at once: a batch of the longest texts still fits.
BATCH_ROWS = 512
#: Elements of an array that are scanned in one piece.
BLOCK = 128
#: Characters that part words.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="vestige-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``. Only a session on one machine may do without: it has one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or _own_folder()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/vestige/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _stashes.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of this driver's stashes.
_stashes: list[str] = []


def stashes() -> list[str]:
    return list(_stashes)


def drop_stashes(spark: SparkSession, paths: list[str]) -> None:
    """Delete stashes that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _stashes.remove(path)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(work, schema)


def whole_text(name: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact position: other columns of any name don't clash."""
    lower = [c.lower() for c in df.columns]
    picked = []
    for name in names:
        at = df.columns.index(name) if name in df.columns else lower.index(name.lower())
        picked.append(at)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at}").alias(name) for at, name in zip(picked, names)])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine) -> Column:
    """For each of an array of ints what ``combine`` (a sum or maximum, from 0) makes of those before it.

    In blocks, so that no array longer than a block, or than the number of blocks, is copied for each element.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def scan(block: Column) -> Column:
        return F.aggregate(block, start, lambda acc, x: F.struct(combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def join(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda b: b["at"]))["out"]
        return let(before, lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda x: combine(x, F.get(base, i)).cast("int")))))

    def cut(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda k: scan(F.slice(xs, k * BLOCK + 1, BLOCK)))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(cut(xs), join)))


def plus(a: Column, b: Column) -> Column:
    return a + b


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
