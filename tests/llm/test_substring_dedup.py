import random

from gridweave.llm.substring_dedup import COVER, PERIOD, remove_repeats


def brute(rows, window=50):
    """Rows of (doc_id, text): words, number removed and kept text by definition."""
    starts = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, ws in split:
        if d is not None:
            for i in range(len(ws) - window + 1):
                k = tuple(ws[i : i + window])
                starts[k] = min(d, starts.get(k, d))
    out = []
    for d, ws in split:
        gone = set()
        if d is not None:
            for i in range(len(ws) - window + 1):
                if starts[tuple(ws[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def make(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    common = [text(n) for n in (49, 50, 51, 60, 90, 300)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [text(rng.randrange(80)), rng.choice(common)]
        rows.append((rng.randrange(10**6), rng.choice(["  ", "\n", " "]).join([*parts, text(5)])))
    rows += [(rows[3][0], rows[3][1]), (7_000_000, rows[3][1]), (7_000_001, rows[3][1].replace("w", "w", 1)), (7_000_002, "same " * 500), (7_000_003, "same " * 90), (7_000_004, common[1] + " x"), (7_000_004, "x " + common[1]), (7_000_005, None), (7_000_006, ""), (None, rows[3][1]), (7_000_007, "é\x1c　" * 60)]
    return rows


def test_brute(spark):
    rows = make()
    df = spark.createDataFrame([(d, t, "c", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, Digest string, hits int").repartition(5)
    got = remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(rows)
    assert {r.hits for r in got} == set(range(len(rows)))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
