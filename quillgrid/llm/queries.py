"""The opN_ queries: each applies its operator to its whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import chat, decontam, exact, langid, packing, pitman_yor, sharding, simhash, suffix, warc
from quillgrid.llm.util import stored


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_documents(spark, sf_dir).select("doc_id", "text"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.learn(docs.where(remainder != 1))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return langid.predict(docs, model).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), with_text=False).withColumnRenamed("id", "doc_id")


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = pitman_yor.score(_documents(spark, sf_dir).select("doc_id", "text"), held_out)
    held_of = F.coalesce(F.crc32(F.col("id").cast("string")) % 7 == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_of.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_groups(_documents(spark, sf_dir).select("doc_id", "text"), digest_all=True)
    return out.withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(_documents(spark, sf_dir), tokenizer_path(), with_ids=False)
    return packing.assign(stored(pieces, "pieces"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_leaks(_documents(spark, sf_dir).select("doc_id", "text"), benchmark).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_simhash, op4_suffix_dedup, op5_pitman_yor, op6_exact_dedup, op7_packing, op8_warc, op9_chat_format, op10_decontaminate)}

ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": exact.ORACLE_SQL, "op9_chat_format": chat.ORACLE_SQL}
