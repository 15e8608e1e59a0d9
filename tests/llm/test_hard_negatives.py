import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, q string, windows int"


def brute(rows, every, positives=5, negatives=5):
    best = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        best[vec_id] = min(best.get(vec_id, r), r)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in best.items():
        if a % every:
            continue
        all_ = sorted((-score(q, w), b, other) for b, (other, w) in best.items() if b != a)
        for s, p, _ in [x for x in all_ if x[2] == label][:positives]:
            inside = [x for x in all_ if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, b, -s, -m) for k, (m, b, _) in enumerate(inside)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[k] for k in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("group, anchor_group, levels", [(8192, 8192, None), (40, 7, None), (60, 9, 2)])
def test_against_all_scores(spark, group, anchor_group, levels):
    """Clusters, many ties (components of two levels), several groups of rows and anchors."""
    rng = np.random.default_rng(group)
    centres = rng.normal(0, 1, (6, 24))
    rows = []
    for k in range(400):
        v = centres[k % 6] + rng.normal(0, 0.5, 24)
        v = np.sign(v) / 8 if levels else v
        rows.append((k, int(rng.integers(0, 4)), v.tolist()))
    df = H.quantised(table(spark, rows))
    assert got(H.mine(df, F.col("vec_id") % 5 == 0, group=group, anchor_group=anchor_group)) == brute(rows, 5)


def test_edge_cases(spark):
    rows = [(0, 1, [1.0, 0.5]), (10, 1, [0.9]), (20, 2, [0.9, 0.1, 0.0]), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 0.0]), (9, 2, [None, 0.0]), (None, 1, [1.0, 0.0]), (11, 3, []), (12, 3, [0.0, 0.0]), (30, 4, [0.9, 0.1]), (30, 4, [0.9, 0.1]), (40, 1, [-1.0, -1.0]), (50, 9, [1000.0, 1000.0])]
    df = table(spark, rows)
    assert got(H.mine(H.quantised(df), F.col("vec_id") % 10 == 0)) == brute(rows, 10)
    assert H.mine(H.quantised(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0
    assert H.mine(H.quantised(df), F.col("vec_id") < 0).count() == 0
    big = [(k, k % 2, [float(2 ** (20 - k % 3)), float(3 * k)]) for k in range(12)]  # scores beyond what doubles hold
    assert got(H.mine(H.quantised(table(spark, big)), F.col("vec_id") == 0)) == brute(big, 12)


def test_bounds_shrink():
    """Most rows are gone before all columns are read, and the answer is that of all scores."""
    rng = np.random.default_rng(1)
    q = np.where(rng.random((2000, 64)) < 0.9, rng.integers(-3, 4, (2000, 64)), rng.integers(-200, 201, (2000, 64)))
    q[7] = q[3] + 1
    block = H.Columns(np.arange(2000), np.zeros(2000, np.int64), q, 1e6)
    ids, scores = H.positives_in(block, 3, 0, q[3], 5)
    want = sorted((-int(q[k] @ q[3]), k) for k in range(2000) if k != 3)[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
    steps = block.scan(q[3], np.arange(2000) != 3)
    at, low, high = next(steps)
    sizes = []
    try:
        while True:
            keep = high >= H._greatest(low, 5) if len(at) > 5 else np.ones(len(at), bool)
            sizes.append(int(keep.sum()))
            at, low, high = steps.send(keep)
    except StopIteration:
        pass
    assert sizes[-2] < 100


def test_query(spark, tmp_path):
    from gridweave.llm.queries import QUERIES

    rng = np.random.default_rng(3)
    rows = [(k, k % 10, rng.normal(0, 0.125, 64).tolist()) for k in range(1000)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(k, (label + 1) % 10 if k % 7 == 0 else label, v) for k, label, v in rows]
    have = got(QUERIES["op12_hard_negatives"](spark, str(tmp_path)))
    assert have == brute(moved, 100) and have
