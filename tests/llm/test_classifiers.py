import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridweave.llm import language_id as L
from gridweave.llm import toxicity as T


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ü", "zt", "ng"]}
    rows, labels = [], []
    for d in range(n):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilexo", "vilexu", "gruntor"]) + rng.choice(["", ",", "."]))
        rows.append((d, " ".join(words), lang))
        labels.append((d, int(toxic)))
    return rows, labels


def test_index_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(T, "BLOCK", 8)
    n, terms = 100, 20
    w = rng.random((n, terms)) * (rng.random((n, terms)) < 0.2)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    blocks = -(-n // 8)
    dense = np.zeros((blocks, terms, 8))
    for k in range(n):
        dense[k // 8, :, k % 8] = w[k]
    index = T.Index(np.arange(terms), np.arange(terms), np.ones(terms), np.arange(blocks * 8), np.zeros(blocks * 8), dense, dense.max(2), 0.1)
    for _ in range(50):
        at = np.sort(rng.choice(terms, 4, replace=False))
        q = rng.random(4)
        q /= np.linalg.norm(q)
        places, cosines = index.nearest(at, q, 7)
        want = np.zeros(blocks * 8)
        want[:n] = w[:, at] @ q
        order = np.lexsort((np.arange(len(want)), -want))[:7]
        order = order[want[order] > 0]
        assert places.tolist() == order.tolist() and np.allclose(cosines, want[order])


def test_toxicity(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in rows] + [(10**6, None, 1), (10**6 + 1, "", 1), (None, "gruntor", 1)], "doc_id long, text string, Term int")
    index = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score(docs, index).collect()}
    assert len(got) == len(rows) + 3
    assert np.mean([got[d].predicted == y for d, y in labels if held(d)]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(not held(n) for r in got.values() for n in r.neighbours)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, None)]])
def test_toxicity_without_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    index = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert T.score(docs, index).count() == 2
    assert T.score(docs.limit(0), index).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(1)
    moves, prior = rng.standard_normal((3, 3)), rng.standard_normal(3)
    lengths = np.array([4, 0, 1, 3])
    emit = rng.standard_normal((8, 3))
    gamma, counts, z = L._forward_backward(emit, lengths, moves, prior, pairs=True)
    at, total, pairs = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.empty((0, 0), int)
        if n:
            score = np.array([prior[p[0]] + sum(emit[at + k, p[k]] for k in range(n)) + sum(moves[p[k], p[k + 1]] for k in range(n - 1)) for p in paths])
            weight = np.exp(score) / np.exp(score).sum()
            total += np.log(np.exp(score).sum())
            for k in range(n):
                assert np.allclose(gamma[at + k], [weight[paths[:, k] == c].sum() for c in range(3)])
            for k in range(n - 1):
                np.add.at(pairs, (paths[:, k], paths[:, k + 1]), weight)
        at += n
    assert np.allclose(counts, pairs) and np.isclose(z, total)


def test_language_works_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    letters = "aéσß中𐐀"
    cores = ["".join(rng.choice(list(letters), n)) for n in (1, 2, 3, 4, 5, 9, 30) for _ in range(8)]
    at = {f: i for i, f in enumerate(sorted({f for w in cores[::2] for f in L.features(w)}))}
    model = L.Model(["aa", "bb", "cc"], at, rng.standard_normal((len(at), 3)) * 2, rng.standard_normal((3, 3)), rng.standard_normal(3))
    words = [*cores, "ΑΣ", "İa", "a1É,", "A", "12", "xͅΣ", "don't"]
    counts = [0, 1, 2, L._BLOCK, L._BLOCK + 1, 3 * L._BLOCK, 1000, 0, 7]
    texts = [" ".join(rng.choice(words, n)) for n in counts]
    emit, parts = [], []
    for w in " ".join(texts).split():
        found = [f for f in L.features(w)]
        emit.append(sum((model.weights[at[f]] for f in found if f in at), np.zeros(3)))
        parts.append(np.mean([f in at for f in found]) if found else np.nan)
    wanted = L._forward_backward(np.array(emit), np.array(counts), model.moves, model.prior)

    def one_by_one(*_):
        raise AssertionError("a step for each word or for each place of a text")

    monkeypatch.setattr(L, "features", one_by_one)
    monkeypatch.setattr(L, "_forward_backward", one_by_one)
    got = L.Tagger(model).tag(texts)
    assert np.allclose(np.concatenate([g for _, g, _ in got]), wanted, atol=1e-12)
    ends = np.cumsum(counts)
    for n, end, (_, _, part) in zip(counts, ends, got):
        own = np.array(parts[end - n : end])
        assert np.isclose(part, np.nanmean(own) if (~np.isnan(own)).any() else 0)
    assert L.Tagger(model).tag([]) == [] and [len(g) for _, g, _ in L.Tagger(model).tag(["", None])] == [0, 0]


def test_language(spark):
    rows, _ = corpus(300, 6)
    odd = [(10**6, None, "aa"), (10**6 + 1, "", None), (10**6 + 2, "12 !? 7", "bb"), (10**6 + 3, "ka " * 30000, None), (None, "ng ng", None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows + odd], "doc_id long, text string, lang string, Word int")
    got = {r.doc_id: r for r in L.predict(docs.drop("lang"), L.train(docs)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert np.mean([got[d].lang_pred == y for d, _, y in rows if held(d)]) > 0.97
    assert [got[10**6 + k].lang_pred for k in range(4)] == ["und", "und", "und", "aa"]
    model = L.train(docs)
    assert 0 < model.least < 0.5 and all(got[d].known >= model.least for d, _, _ in rows)
    strange = spark.createDataFrame([(1, "привет мир 77"), (2, "ka lo 77 mi"), (3, "77")], "doc_id long, text string")
    known = {r.doc_id: r.known for r in L.predict(strange, model).collect()}
    assert known[1] == 0 and known[2] > 0.8 and known[3] == 0
    mixed = L.Tagger(L.train(docs)).tag(["ka lo mi ru kalo schü ztng ngzt üng"])[0][1]
    assert mixed[:5].argmax(1).tolist() == [0] * 5 and mixed[5:].argmax(1).tolist() == [1] * 4


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.predict(docs.drop("lang"), L.train(docs)).collect()] == ["und"]


def test_toxicity_keeps_every_term(spark):
    rows = [(k, f"common words here only{k}", int(k % 3 == 0)) for k in range(300)]
    rows = [r for r in rows if not held(r[0])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    index = T.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    d, text, _ = rows[7]
    asked = spark.createDataFrame([(-1, f"only{d}"), (-2, text), (-3, f"only{d} neverseen")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(asked, index).collect()}
    wanted = T.ids_of(np.array(sorted({t for _, text, _ in rows for t in T.terms_of(text.split()[-1])}), object))
    assert (index.codes[T.places_in(index.known, wanted)] >= 0).all() and (T.places_in(index.known, wanted) >= 0).all()
    assert got[-1].neighbours[0] == d and got[-2].neighbours[0] == d and np.isclose(got[-2].cosines[0], 1, atol=1e-5)
    assert 0 < got[-3].cosines[0] < got[-1].cosines[0]


def test_toxicity_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "DENSE", 7)
    monkeypatch.setattr(T, "BLOCK", 8)
    rows, labels = corpus(150)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    index = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    size, counts = len(index.ids), {d: {} for d, _, _ in rows}
    every = sorted({t for _, text, _ in rows for c in text.split() for t in T.terms_of(c)})
    at = T.places_in(index.known, T.ids_of(np.array(every, object)))
    terms = {t: int(index.codes[k]) for t, k in zip(every, at) if k >= 0}
    for d, text, _ in rows:
        for c in text.split():
            for t in T.terms_of(c):
                counts[d][t] = counts[d].get(t, 0) + 1

    def vector(d):
        v = {t: (1 + np.log(n)) * (index.idf[terms[t]] if t in terms else index.unseen) for t, n in counts[d].items()}
        z = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / z for t, x in v.items()}

    known = {int(d): vector(int(d)) for d in index.ids}
    assert set().union(*(counts[d] for d in known)) == set(terms)
    y = dict(labels)
    for t, k in terms.items():  # idf over all documents, chi-square over the examples
        a, b = sum(t in counts[d] for d in known), sum(t in counts[d] and y[d] for d in known)
        p = sum(y[d] for d in known)
        chi2 = size * (b * (size - p) - (a - b) * p) ** 2 / max(a * (size - a) * p * (size - p), 1) if a < size else 0
        assert np.isclose(index.idf[k], (np.log((1 + len(rows)) / (1 + sum(t in c for c in counts.values()))) + 1) * (1 + np.sqrt(chi2)))
    assert np.isclose(index.unseen, 1 + np.log(1 + len(rows)))
    for r in T.score(docs, index).collect():
        q = vector(r.doc_id)
        want = sorted((sum(x * v.get(t, 0) for t, x in q.items()) for v in known.values()), reverse=True)[: T.NEIGHBOURS]
        assert np.allclose(r.cosines, [c for c in want if c > 0], atol=1e-5)
        assert np.allclose(r.cosines, [sum(x * known[n].get(t, 0) for t, x in q.items()) for n in r.neighbours], atol=1e-5)


def test_language_learns_from_any_run(spark):
    """Words that stand at the end of a long text alone teach as well as the first ones, and all its runs stand to be chosen."""
    body = "ka lo mi ru " * 2000 + "vexulo " * 300
    docs = spark.createDataFrame([(1, body, "aa"), (1, body, "aa"), (2, "schü zot ing " * 700, "bb")], "doc_id long, text string, lang string")
    model = L.train(docs)
    assert {"=vexulo", "=ka", "=schü"} <= set(model.at)
    few = L.train(docs, max_runs=2)
    assert len(few.at) < len(model.at)


def test_tally_with_signs_of_all_kinds():
    """Signs within and beyond ASCII part words, in texts that are slices too."""
    texts = [None, "", "plain_text's end", "«Größe» – naïve—café…", "a\x00b\x7fc\tdé", "x" * 70 + "! " + "x" * 71, " 　ÉCOLE école", "数据 data№5 ½"]
    held_ = pa.array(["dropped, too", *texts], pa.string()).slice(1)
    got = T.tally(held_)
    found = {(k, int(i)): int(n) for k, i, n in zip(got.text, got.ids[got.term], got.times)}
    want = {}
    for k, t in enumerate(texts):
        for term in T.terms_of(t or ""):
            key = k, int(T.ids_of(np.array([term], object))[0])
            want[key] = want.get(key, 0) + 1
    assert found == want and (np.diff(got.text) >= 0).all()


def test_index_is_built_in_little_memory():
    """What is worked out while examples are put in an index takes little more than the index does."""
    rng = np.random.default_rng(3)
    size, terms, per = 4000, 60_000, 400
    at = np.concatenate([rng.choice(terms, per, False) for _ in range(size)]).astype(np.int32)
    rows = T.Examples(np.arange(size), (rng.random(size) < 0.1).astype(float), np.arange(size) * per, np.full(size, per), at, np.ones(len(at), np.float32))
    tracemalloc.start()
    index = T.build(rows, np.arange(size), np.arange(terms), np.ones(terms), size)
    held_, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 2.2 * held_ and len(index.places) == len(index.values) == index.starts[-1]


def test_postings_of_a_term_lie_together():
    """Place and weight of a posting are neighbours, so a term's postings are one run of bytes; sums are those of single postings."""
    rng = np.random.default_rng(8)
    size, terms, per = 300, 3000, 60
    at = np.concatenate([rng.choice(terms, per, False) for _ in range(size)]).astype(np.int32)
    rows = T.Examples(np.arange(size), (rng.random(size) < 0.3).astype(float), np.arange(size) * per, np.full(size, per), at, np.ones(len(at), np.float32))
    index = T.build(rows, np.arange(size), np.arange(terms), np.ones(terms), size)
    assert np.may_share_memory(index.places, index.values) and len(index.places) == index.starts[-1] > 0
    text, asked = np.repeat([0, 2], 40), rng.integers(0, len(index.starts) - 1, 80)
    w = rng.random(80).astype(np.float32)
    want = np.zeros((3, index.weights.shape[0] * index.weights.shape[2]))
    for k, a, x in zip(text, asked, w):
        for i in range(index.starts[a], index.starts[a + 1]):
            want[k, index.places[i]] += x * index.values[i]
    assert np.allclose(index._postings(3, text, asked, w), want, atol=1e-6)
