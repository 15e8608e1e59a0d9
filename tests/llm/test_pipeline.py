"""The pipeline and each of its stages against brute force on a small corpus with planted cases."""

import random

import corpus_pipeline as C
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_classifiers import held
from tests.llm.test_minhash_dedup import lcs_similarity

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru", "ten"], "bb": ["sch", "ün", "zot", "ing"]}


def plant():
    """Rows of documents and labels: clean texts, toxic ones, copies, near copies, shared passages, texts without letters."""
    rng = random.Random(8)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 5)))
    passage = [word("aa") for _ in range(60)]
    docs, labels = [], []
    for d in range(160):
        lang = rng.choice(list(SYLLABLES))
        words = [word(lang) for _ in range(rng.randrange(60, 140))]
        toxic = d % 6 == 1
        if toxic:
            words[5:5] = ["vilexo", "gruntor"]
        if d % 10 == 3:
            words[20:20] = passage
        if d % 10 == 7 and docs:
            words = docs[-1][1].split()
            if d % 20 == 7:
                words[30] = "other"
        docs.append((d, " ".join(words), lang, "s", len(" ".join(words))))
        labels.append((d, int("gruntor" in words)))
    docs += [(1000, None, None, "s", None), (1001, "", "aa", "s", 0), (1002, "12 34 !", "aa", "s", 7), docs[0]]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs, labels = plant()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_batches_are_short(spark, tables):
    """Workers get a bounded number of rows at a time, and a number of the session's own stays."""
    from gridweave.llm.common import BATCH, BATCH_ROWS

    docs = spark.read.parquet(f"{tables}/documents.parquet").drop("text").limit(1)
    most = lambda: max(r.n for r in spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long").collect())

    def sizes(batches):
        import pyarrow as pa

        yield from (pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"]) for b in batches)

    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.unset(BATCH)
        for _, stage in C.STAGES:
            spark.conf.unset(BATCH)
            with pytest.raises(Exception, match="text"):  # no stage does without texts
                stage(spark, docs, tables)
            assert most() == BATCH_ROWS
        spark.conf.set(BATCH, "700")
        with pytest.raises(Exception, match="text"):
            C.not_toxic(spark, docs, tables)
        assert most() == 700
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def without_repeats(rows):
    """Rows after every word in a 50-word window that a document of lower id has too is gone."""
    first, out = {}, []
    for d, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    for d, text in rows:
        w = (text or "").encode().split()
        gone = {i + k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for k in range(50)}
        if len(gone) < len(w) or not w:
            out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else text))
    return sorted(out, key=repr)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    read = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    stage = dict(C.STAGES)
    assert list(stage) == ["language_id", "toxicity", "minhash_dedup", "substring_dedup", "best_fit_packing"]

    before = read(docs)
    docs = stage["language_id"](spark, docs, tables)
    assert docs.columns == C.COLUMNS
    kept = read(docs)
    assert sorted(kept) == sorted((d, t) for d, t in before if t and any(c.isalpha() for c in t))

    docs = stage["toxicity"](spark, docs, tables)
    before, kept = kept, read(docs)
    toxic = {(d, t) for d, t in before if "gruntor" in t}
    assert set(kept) <= set(before) and docs.columns == C.COLUMNS
    assert len(toxic & set(kept)) <= 0.1 * len(toxic) and len(set(before) - toxic - set(kept)) <= 0.02 * len(before)
    assert any(held(d) for d, _ in toxic - set(kept))

    docs = stage["minhash_dedup"](spark, docs, tables)
    before, kept = kept, read(docs)
    root = {d: d for d, _ in before}
    texts = sorted(set(before))
    for k, (a, x) in enumerate(texts):
        for b, y in texts[:k]:
            if x == y or lcs_similarity(x.encode().split(), y.encode().split()) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert sorted(kept) == sorted((d, t) for d, t in before if root[d] == d)
    assert len(kept) < len(set(before))

    docs = stage["substring_dedup"](spark, docs, tables)
    before, rows = kept, docs.collect()
    assert sorted([(r.doc_id, r.text) for r in rows], key=repr) == without_repeats(before)
    assert all(r.n_chars == len(r.text) for r in rows) and docs.columns == C.COLUMNS

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stage["best_fit_packing"](spark, docs, tables).collect()
    want = sum(len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in packed) == want
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= C.CAPACITY
    assert len(used) <= -(-want // C.CAPACITY) + 1


def test_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, tables)
    count = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert count(C.run(spark, tables)) == count(docs)


def test_empty(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_near_copies_in_a_large_group_of_unlike_texts_go(spark):
    from tests.llm.test_minhash_dedup import crowd

    rows, pairs = crowd()
    docs = spark.createDataFrame([(d, " ".join(w), "aa", "x", 1) for d, w in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(r.doc_id for r in C.one_of_each(spark, docs, "").collect())
    assert got == sorted(d for d, _ in rows if d % 2 == 0)
