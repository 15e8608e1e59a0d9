"""Columns named like those that an operator adds are refused, whatever their case."""

import numpy as np
import public_tokenizers as P
import pytest

from gridweave.llm import bpe, language_id, minhash_dedup, packing, quality_rules, substring_dedup, toxicity

NONE = np.empty(0, np.int64)
REFUSED = {
    "op1 ids": (lambda df: bpe.bpe_encode(df, P.path("byte_bpe_50k.json"), ids="extra"), "extra"),
    "op1 text": (lambda df: bpe.bpe_decode(df, P.path("byte_bpe_50k.json"), text="extra"), "extra"),
    "op2": (lambda df: toxicity.score(df, toxicity.Index(NONE, NONE, np.empty(0), NONE, np.empty(0), np.empty((0, 0, 1)), np.empty((0, 0)), 0.0)), "Score"),
    "op3": (lambda df: language_id.predict(df, language_id.Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))), "KNOWN"),
    "op4": (quality_rules.clean, "Kept"),
    "op5": (substring_dedup.remove_repeats, "N_Words"),
    "op6": (minhash_dedup.near_duplicates, "Class_ID"),
    "op9": (lambda df: packing.pack(df.selectExpr("*", "1L AS length"), 8), "Offset"),
}


@pytest.mark.parametrize("name", REFUSED)
def test_refused(spark, name):
    run, column = REFUSED[name]
    docs = spark.sql(f"SELECT 1L AS doc_id, 'a b' AS text, 0 AS `{column}`")
    with pytest.raises(ValueError):
        run(docs)
