import random

import numpy as np

from gridweave.llm.minhash_dedup import aligned, labelled, near_duplicates, sketch_keys
from gridweave.operators.graph import connected as components


def lcs_similarity(x, y):
    """By the textbook table over five-word shingles."""
    a, b = (["\0".join(map(bytes.decode, w[i : i + 5])) for i in range(max(1, len(w) - 4))] for w in (x, y))
    row = [0] * (len(b) + 1)
    for s in a:
        old = row[:]
        for j, t in enumerate(b):
            row[j + 1] = old[j] + 1 if s == t else max(row[j], old[j + 1])
    return row[-1] / (len(a) + len(b) - row[-1])


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(3, 220))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.1:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            rows.append((rng.randrange(10**7), " ".join(w)))
    return rows + [(10**8, None), (10**8 + 1, ""), (10**8 + 2, "a b"), (10**8 + 3, " a\nb "), (rows[0][0], rows[0][1]), (None, rows[0][1])]


def test_aligned():
    rng = random.Random(2)
    for _ in range(60):
        x = [f"w{rng.randrange(400)}".encode() for _ in range(rng.randrange(1, 150))]
        y = list(x)
        for _ in range(rng.randrange(3)):
            y[rng.randrange(len(y))] = b"new"
        got, want = aligned(labelled(x), labelled(y), 0.8), lcs_similarity(x, y)
        assert (got >= 0.8) == (want >= 0.8)
        assert got == 0 or abs(got - want) < 1e-9


def test_keys_follow_order():
    w = [f"w{i}".encode() for i in range(300)]
    same = (sketch_keys(labelled(w)) == sketch_keys(labelled([*w[:299], b"z"]))).mean()
    swapped = (sketch_keys(labelled(w)) == sketch_keys(labelled(w[150:] + w[:150]))).mean()
    assert same > 0.8 > 0.6 > swapped


def test_brute(spark):
    rows = corpus()
    ids = [d for d, t in rows if d is not None]
    text = {d: (t or "").encode().split() for d, t in rows if d is not None}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(text):
        for b in list(text)[i + 1 :]:
            if text[a] and text[b] and 0.79 < len(text[a]) / len(text[b]) < 1.27 and lcs_similarity(text[a], text[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, Digest string, mine int").repartition(4)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id) for r in got} == {(d, find(d) if d is not None else None) for d, _ in rows}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: r for x, r in root.items() if sum(s == r for s in root.values()) > 1}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def crowd(seed=8, size=180, pairs=20):
    """Texts with most of their words in common, none a near copy of another but for some pairs."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(204)]
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(size):
        tail = fresh(30)
        rows.append((2 * k, [*common, *tail]))
        if k < pairs:
            rows.append((2 * k + 1, [*common, *tail[:6], *fresh(24)]))
    return rows, pairs


def test_large_groups_of_unlike_texts_are_compared_whole(spark):
    rows, pairs = crowd()
    shingled = {d: labelled([x.encode() for x in w]) for d, w in rows}
    linked = {(a, b) for a in shingled for b in shingled if a < b and aligned(shingled[a], shingled[b], 0.8) >= 0.8}
    assert linked == {(2 * k, 2 * k + 1) for k in range(pairs)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_bitmaps_turn_no_near_copy_away(spark):
    from gridweave.llm.minhash_dedup import _rest, allowed, bitmaps

    rng = random.Random(4)
    texts = []
    for size in (1, 7, 60, 64, 130, 500):
        base = [f"w{rng.randrange(3 * size)}".encode() for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(1 + size // 30)):
                w[rng.randrange(size)] = f"x{rng.randrange(10**6)}".encode()
            texts.append(labelled(w + [b"new"] * rng.randrange(1 + size // 5)))
    texts.sort(key=len)
    bits = [bitmaps(t, np.array([len(t)]))[0] for t in texts]
    assert bits == bitmaps(np.concatenate(texts), np.array([*map(len, texts)]))
    alike = {(a, b) for b in range(len(texts)) for a in range(b) if aligned(texts[a], texts[b], 0.8) >= 0.8}
    found = {(a, int(b)) for a, bs in allowed(np.array([*map(len, texts)]), bits, 0.8) for b in bs}
    assert alike <= found and len(found) < len(texts) * (len(texts) - 1) // 4
    entries = spark.createDataFrame([(0, 5, k, len(t), k, len(texts)) for k, t in enumerate(texts)], "band int, key long, node long, size int, part long, n long")
    held = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bits)], "node long, bits binary")
    for share in (7, 1000):  # in many cells or in one, each pair once
        got = [tuple(sorted((r.a, r.b))) for r in _rest(entries, held, 0.8, share).collect()]
        assert len(got) == len(set(got)) and set(got) == found


def test_ids_of_several_texts_in_large_groups(spark):
    """Of texts with one id each is compared by its own bitmap."""
    rng = random.Random(1)
    rows, pairs = crowd()
    longer = [(2 * k, [*(f"d{n}" for n in range(900)), *(f"y{rng.randrange(10**9)}" for _ in range(130))]) for k in range(60)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows + longer], "doc_id long, text string").repartition(4)
    shingled = [(d, labelled([x.encode() for x in w])) for d, w in rows + longer]
    linked = {(c, d) for k, (c, a) in enumerate(shingled) for d, b in shingled[k + 1 :] if c != d and aligned(a, b, 0.8) >= 0.8}
    assert len(linked) >= pairs
    root = {d: d for d, _ in rows}
    for _ in root:
        for c, d in linked:
            root[c] = root[d] = min(root[c], root[d])
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(df).collect()) == sorted((d, root[d]) for d, _ in rows + longer)
