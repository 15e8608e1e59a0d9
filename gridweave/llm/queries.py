"""The registered queries of this folder; thin, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.bpe import bpe_decode, bpe_encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    return bpe_decode(ids, path).select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.packing import cut, pack

    return pack(cut(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048), 2048)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.token_files import read_tokens, with_starts, write_tokens

    path = shared_dir(spark)
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    docs = read_tokens(spark, path).select("shard", "at", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(docs, path)


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.substring_dedup import remove_repeats

    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.minhash_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "kept")


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.embedding_dedup import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.quality_rules import clean

    return clean(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "clean_text")


@query
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.licences import scan

    return scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "licence_digest", "licence")


def _sql() -> None:
    from gridweave.llm import hard_negatives, licences, quality_rules, spelling

    ORACLE_SQL["op4_quality_rules"] = quality_rules.ORACLE
    ORACLE_SQL["op8_licences"] = licences.ORACLE
    ORACLE_SQL["op11_spelling_variants"] = spelling.ORACLE
    ORACLE_SQL["op12_hard_negatives"] = hard_negatives.ORACLE


_sql()


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm import toxicity
    from gridweave.llm.common import held_out

    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm import language_id
    from gridweave.llm.common import held_out

    docs = documents(spark, sf_dir)
    scored = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.spelling import count_words, group_variants

    return group_variants(count_words(documents(spark, sf_dir)).where("n >= 3"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.hard_negatives import mine, quantised

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(quantised(moved), F.col("vec_id") % 100 == 0)


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridweave.llm.sharding import shard_documents

    put = shard_documents(documents(spark, sf_dir), 16)
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
