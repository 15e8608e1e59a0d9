"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but
the last return the columns of ``documents``. ``run`` writes each result to the shared folder and reads it again.

Rejected go documents whose language is unknown (no letter in them, or hardly a part of words that the language model
learned: less than half of what any text that taught it has), toxic documents, all but one document of each
group of near duplicates, and documents that repeated passages fill wholly; passages that repeat elsewhere are cut
out, with the blanks of what stays of such a document made single.

Null texts and texts without letters go with the language stage, and so do all if no language could be learned; ties and
repeated rows are decided by each stage as its operator states (of equal rows one stays); texts of any length are read whole;
an empty table gives an empty one; the session's rows of a batch are set to ``BATCH_ROWS`` if it has no number of its own; columns beside those of ``documents`` are dropped first, so that none can clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import language_id, minhash_dedup, packing, substring_dedup, toxicity
from gridweave.llm.common import materialise, short_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CAPACITY = 2048
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_short_batches(stage: Stage) -> Stage:
    """A stage whose workers get few texts at a time: executors go from stage to stage with what memory they took."""

    @wraps(stage)
    def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    return inner


@in_short_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("known") >= model.least)).select(*COLUMNS)


@in_short_batches
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), index).where("predicted = 0").select(*COLUMNS)


@in_short_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


@in_short_batches
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(docs.select(*COLUMNS)).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@in_short_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY), CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("minhash_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]
#: SQL can express neither the classifiers nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
