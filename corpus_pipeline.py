"""The corpus pipeline: a document table in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept: low quality goes, lines that many documents share go, one
document of each group of near-duplicates stays, personal data is replaced by
tags, and what is left is packed. ``n_chars`` follows the text. Any column may
be null; columns beyond those of ``documents``, of any name, are left out; an
empty table gives no rows; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm import line_dedup, near_dup, packing, pii, quality_rules
from vestige.llm import queries as q
from vestige.llm.shared import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of_documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learnt rules keep. Null and empty texts go; without labels only the base rule works. Each of repeated rows is judged alike."""
    return quality_rules.keep_good(docs, q.labels(spark, sf_dir)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 and more code points in three or more documents stay only in the largest id. No document goes, even if no line is left. Null texts become empty."""
    return _of_documents(line_dedup.dedup_lines(docs, 20, 3, carry=("lang", "source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, the least id; of rows of that id the least text. Documents without words, and rows without id, stay."""
    return near_dup.keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, replaced by tags. No document goes. Null texts become empty."""
    return _of_documents(pii.sanitise(docs, carry=("lang", "source")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 ids, each with its place in a sequence. An empty text is its end id alone; rows without id and repeated rows are packed too."""
    return packing.pack_documents(docs, q.tokenizer_file("byte_bpe_50k.json"), q.END_ID, 1024)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]

#: The learnt stages can't be written as SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again before the next."""
    docs = q.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
