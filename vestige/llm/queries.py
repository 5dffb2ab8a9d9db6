"""The operators of this subpackage, with production parameters, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm import alignment, bpe, fingerprints, language_id, line_dedup, merkle, near_dup, oracle, packing, pii, quality_rules, repeats, token_files, toxicity
from vestige.llm.shared import documents, labels

Query = Callable[[SparkSession, str], DataFrame]

#: The id that ends a document.
END_ID = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), END_ID, 1024)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_table(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.held_out(5, 0)
    return toxicity.score_texts(documents(spark, sf_dir), labels(spark, sf_dir), ~held_out, held_out)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of the fingerprints of operator 6, joined and verified."""
    return fingerprints.similar_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_shingles")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir), 20, 3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), ~language_id.held_out(4, 2))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), END_ID)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = repeats.drop_repeats(documents(spark, sf_dir))
    return short.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_tampered(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_bpe, op3_best_fit_packing, op4_pii, op5_toxicity, op6_fingerprints, similar_classes, op7_near_dup, op8_line_dedup, op9_language_id, op10_token_files, op11_token_alignment, op12_suffix_dedup, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": oracle.OP8, "similar_classes": oracle.SIMILAR, "op12_suffix_dedup": oracle.REPEATS, "op13_merkle_manifest": oracle.MERKLE}
