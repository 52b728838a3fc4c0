"""The corpus queries of the driver's contract: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, packing, positional_index, quality_rules, sentence_spans, source_audit, suffix_dedup, token_store, warc,
)
from ._shared import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.decide(documents(spark, sf_dir))
    each = rows.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_groups(documents(spark, sf_dir), k=3, percent=90)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removal_report(documents(spark, sf_dir), min_words=1)


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeats(documents(spark, sf_dir), passage=51).select("doc_id", *sentence_spans.COUNTED, F.sha2("text", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.full_payloads(warc.read_warc(spark, archives))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(documents(spark, sf_dir))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_store.write_store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.store_digest(token_store.read_store(spark, path))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    codes = hard_negatives.build_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)
    return hard_negatives.mine(codes, F.col("vec_id") % 100 == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = positional_index.build_index(documents(spark, sf_dir))
    return positional_index.contamination(index, positional_index.phrase_matches(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


_ALL = (
    op1_packing, op2_mixing, op3_jaccard_join, op4_exact_dedup, op5_line_dedup, op6_sentence_spans, op7_warc, op8_quality_rules, op9_suffix_dedup, op10_token_store,
    op11_hard_negatives, op12_decontamination, op13_source_audit,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op7_warc": warc.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE, "op12_decontamination": positional_index.ORACLE, "op13_source_audit": source_audit.ORACLE,
}
