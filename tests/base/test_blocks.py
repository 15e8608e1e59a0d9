"""Matching in blocks against all pairs one by one."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridweave.operators import blocks as B
from gridweave.operators import descriptors as M
from gridweave.operators import points as T
from gridweave.operators import vectors as V

SCHEMA = "id long, x double, y double, descr array<float>"


def kp(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def points(rng, n, span, first=0):
    """Keypoints with many equal descriptors, and odd ones: nulls, other lengths, what is no number."""
    rows = [(first + k, *map(float, rng.uniform(-span, span, 2)), [float(v) for v in rng.integers(-2, 3, 4)]) for k in range(n)]
    odd = [None, [], [1.0], [None, 1.0, 1.0, 1.0], [math.nan, 1.0, 1.0, 1.0], [math.inf, 1.0, 1.0, 1.0], [1e30] * 4]
    return rows + [(first + n + k, 0.5 * k, 0.0, d) for k, d in enumerate(odd)] + [(first + n + 50, None, 1.0, [1.0] * 4), (first + n + 51, math.nan, 1.0, [1.0] * 4)]


def gap(p, q):
    """Distance of two descriptors, None if there is none."""
    if p is None or q is None or len(p) != len(q) or any(v is None or not math.isfinite(v) for v in p + q):
        return None
    s = 0.0
    for v, w in zip(p, q):
        s += (float(np.float32(v)) - float(np.float32(w))) ** 2
    return math.sqrt(s)


def nearest(a, b, may, t):
    out = {}
    for i, x, y, d in a:
        for k, u, v, e in b:
            far = gap(d, e)
            if far is not None and far < t and None not in (x, u) and may(x, y, u, v) and (i not in out or (far, k) < out[i]):
                out[i] = (far, k)
    return {(i, k, d) for i, (d, k) in out.items()}


def got(df):
    return {(r["from"], r["to"], r["d"]) for r in df.collect()}


def test_epipolar(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = points(rng, 150, 40.0), points(rng, 170, 40.0, 1000)
    turned = [0.0, 0.0, 0.1, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0]
    pole = [0.0, -1.0, 7.0, 1.0, 0.0, -3.0, -7.0, 3.0, 0.0]  # lines through 3, 7
    for m, eps, small in ((turned, 4.0, True), (pole, 1.5, False), (pole, 30.0, True), ([0.0] * 9, 4.0, False)):

        def near(x, y, u, v, m=m, eps=eps):
            la, lb, lc = (m[3 * k] * x + m[3 * k + 1] * y + m[3 * k + 2] for k in range(3))
            return (la != 0 or lb != 0) and abs(la * u + lb * v + lc) / math.hypot(la, lb) <= eps / 2

        with monkeypatch.context() as held:
            for module, name, value in ((B, "BLOCK", 40), (B, "PAIRS", 700), (M, "SECTORS", 4)):
                held.setattr(module, name, value if small else getattr(module, name))
            assert got(M.match_epipolar(kp(spark, a), kp(spark, b), m, 2.5, eps)) == nearest(a, b, near, 2.5)
    one = kp(spark, a)
    assert M.match_epipolar(one, one.limit(0), turned, 2.5, 4.0).count() == 0
    # a wide image and a narrow strip: rows must not be made for each step along a line
    far = [(k, 5e9 * (k % 2), float(k // 2), [0.0]) for k in range(40)]
    assert got(M.match_epipolar(kp(spark, far), kp(spark, far), [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0], 1.0, 1.0)) == {(k, k // 2 * 2, 0.0) for k in range(40)}


def test_medoid(spark, monkeypatch):
    """Of vectors and their negatives two have the same sum, added in another order: the first image wins, as after rounding in SQL."""
    rng = np.random.default_rng(2)
    cells = {}
    for i in range(8):
        half = rng.normal(0, 1, (45 if i % 2 else 10, 3))
        cells[i] = rng.permutation(np.vstack([half, -half]))
    cells[8] = np.repeat(rng.normal(0, 1, (20, 3)), 4, 0)[::-1]  # copies
    cells[9] = np.ones((90, 3))
    cells[10] = np.vstack([rng.normal(0, 1, (60, 3)), np.full((2, 3), math.nan)])
    cells[11] = np.vstack([np.full((1, 3), math.inf), rng.normal(0, 1, (60, 3))])
    cells[12] = rng.normal(0, 1e200, (70, 3))
    cells[13] = rng.normal(0, 1e-9, (70, 3)) + 5
    rows = [(k, 0, i, c, float(v)) for i, x in cells.items() for k, vector in enumerate(x) for c, v in enumerate(vector)]
    px = spark.createDataFrame(rows, "image_id long, j int, i int, c int, v double").repartition(5)
    with np.errstate(invalid="ignore", over="ignore"):
        want = {}
        for i, x in cells.items():
            sums = [math.fsum(np.sqrt(((x - v) ** 2).sum(1))) if np.isfinite(x).all() and abs(x).max() < 1e100 else float(np.sqrt(((x - v) ** 2).sum(1)).sum()) for v in x]
            low = np.nan_to_num(np.array(sums), nan=math.inf, posinf=1e308)
            want[i] = x[np.flatnonzero(low <= low.min() * (1 + 1e-13))[0]]
    monkeypatch.setattr(B, "BLOCK", 40)
    got = {}
    for r in V.accumulate_vec(px, "med").collect():
        got.setdefault(r.i, {})[r.c] = r.v
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert [got[i][c] for c in range(3)] == x.tolist() or np.isnan(x).all(), i
    odd = spark.createDataFrame([(1, 0, 0, 0, 5.0), (2, 0, 0, 0, None), (3, 0, 0, 0, 6.0)], px.schema)
    assert [tuple(r) for r in V.accumulate_vec(odd, "med").collect()] == [(0, 0, 0, 5.0)] and V.accumulate_vec(odd.limit(0), "med").count() == 0


def test_dedup_in_parts(spark, monkeypatch):
    """Many keypoints in few places: what is near a kept one goes before its pairs are made. Ids in order of place, ids at random, odd rows."""
    rng = np.random.default_rng(4)
    rows = points(rng, 300, 12.0)
    rows += [(2000 + k, *map(float, rng.normal(0, 1, 2)), [float(v) for v in rng.integers(0, 2, 4)]) for k in range(200)]
    rows += [(3000 + k, 0.1 * k, 0.0, [0.0] * 4) for k in range(200)] + [(None, 0.0, 0.0, [0.0] * 4)]
    kept, made = [], []
    for k, x, y, d in sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]):
        if x is None or not any(gap(d, e) is not None and gap(d, e) < 1.5 and math.hypot(x - u, y - v) < 3 for _, u, v, e in kept if u is not None):
            kept.append((k, x, y, d))
    write = M.materialise

    def counted(df):
        out = write(df)
        if df.columns == ["a", "b"]:
            made.append(out.count())
        return out

    whole = M.near_keypoints(kp(spark, rows), 3.0, 1.5).count()
    monkeypatch.setattr(M, "materialise", counted)
    monkeypatch.setattr(M, "MOST_PAIRS", 20000)
    got = [r.id for r in M.dedup_keypoints(kp(spark, rows), 3.0, 1.5).collect()]
    assert sorted(k for k in got if k is not None) == sorted(k for k, *_ in kept) and got.count(None) == 1
    assert 0 < max(made) < whole / 2
    same = [(7, 0.0, 0.0, [0.0])] * 400 + [(6, 1.0, 0.0, [0.0])]
    assert [r.id for r in M.dedup_keypoints(kp(spark, same), 3.0, 1.5).distinct().collect()] == [7]


def test_window(spark, monkeypatch):
    """Tiles of many windows and of one, blocks of few rows; differences that rounding brings to just the window."""
    rng = np.random.default_rng(6)
    a, b = points(rng, 200, 9.0), points(rng, 260, 9.0, 1000)
    a += [(500, 2.0, 0.0, [9.0]), (501, -3.0, 5.0, [9.0])]
    b += [(2000, 1.0 - 2.0**-53, 0.0, [9.0]), (2001, -3.0, 6.0, [9.0])]
    want = nearest(a, b, lambda x, y, u, v: abs(x - u) <= 1 and abs(y - v) <= 2, 3.0)
    assert (500, 2000, 0.0) in want and (501, 2001, 0.0) in want
    assert got(T.match_window(kp(spark, a), kp(spark, b), 1.0, 2.0, 3.0)) == want
    for name, value in (("BLOCK", 6), ("PAIRS", 20), ("FEW", 1)):
        monkeypatch.setattr(B, name, value)
    assert got(T.match_window(kp(spark, a), kp(spark, b), 1.0, 2.0, 3.0)) == want
    named = kp(spark, a).withColumn("id", F.concat(F.lit("k"), "id"))  # ids that are no numbers
    assert {(r["from"], r["to"], r["d"]) for r in T.match_window(named, kp(spark, b), 1.0, 2.0, 3.0).collect()} == {(f"k{i}", k, d) for i, k, d in want}
