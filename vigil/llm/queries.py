"""The thin queries of this subpackage: one per operator, over its whole table with production parameters."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import chat, decontam, embed_dup, html_text, near_dup, packing, periodic_runs, pii, quality, substring_dedup, token_count, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer lies: $VIGIL_TOKENIZERS, else what the installed package of files says."""
    folder = os.environ.get("VIGIL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).drop("ids")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("matches")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(text).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(planted)).drop("turns"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(_table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op9_embed_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents")).drop("intervals")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).drop("n_blocks", "n_kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.tiled_tails(_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_chat": op4_chat,
    "op5_tokens": op5_tokens,
    "op6_warc": op6_warc,
    "op7_near_dup": op7_near_dup,
    "op8_pii": op8_pii,
    "op9_embed_dup": op9_embed_dup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_html": op11_html,
    "op12_whitening": op12_whitening,
    "op13_runs": op13_runs,
}
