import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridweave.llm import spelling


def brute(docs, least=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return n


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r[k] for k in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_words(spark):
    texts = ["Étude étude ÉTUDE naïve×naïve ÷÷÷÷÷ Straße", None, "", " \n123 ---", "aaaaaa " * 3000 + "x" * 70000, "weißĀweißes ＡＢＣＤＥ words_words WORDS's", "colour color colours colur"]
    docs = [(k, t) for k, t in enumerate(texts)] * 2 + [(None, "colour colour"), (k := 10, " ".join(f"word{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)))]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == brute(docs)
    assert spelling.count_words(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [spelling.LIMIT, 2])
def test_against_all_pairs(spark, limit):
    """Random words over few letters; with a limit of 2 nearly every key is split, down to single code points."""
    rng = random.Random(limit)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): rng.choice([3, 3, 4, 8, 20, 50]) for _ in range(400)}
    for k in range(60):  # a common beginning, a common end
        n["internation" + rng.choice("abcd") * rng.randint(1, 3) + rng.choice("xyz")] = 3 + k
        n[rng.choice("abcd") + rng.choice("xyz") + "ation" * 3] = 3 + k
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows(spelling.group_variants(df, limit=limit)) == grouped(n)


def test_edge_cases(spark):
    df = spark.createDataFrame([("words", 3), ("words", 4), (None, 9), ("wordz", 3), ("w" * 5000, 3), ("w" * 5001, 6), ("alone", 5)], "word string, n long")
    assert rows(spelling.group_variants(df)) == grouped({"words": 7, "wordz": 3, "w" * 5000: 3, "w" * 5001: 6, "alone": 5})
    assert spelling.group_variants(df.limit(0)).count() == 0
    chain = {"abcdefg" + "xyzuvw"[:k]: 3 * 2**k for k in range(6)}
    assert rows(spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long"))) == grouped(chain)


def test_query(spark, tmp_path):
    """The registered query against brute force over a whole table of texts with slips."""
    from gridweave.llm.queries import QUERIES

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rng.randint(4, 12))) for _ in range(60)]
    docs = [(k, " ".join(rng.choices(base, [1 / (j + 1) for j in range(60)], k=120))) for k in range(300)] + [(400, None), (401, "")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("form", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    n = {w: k for w, k in brute(docs).items() if k >= 3}
    got = rows(QUERIES["op11_spelling_variants"](spark, str(tmp_path)))
    assert got == grouped(n) and sum(r[1] is not None for r in got) > 20
