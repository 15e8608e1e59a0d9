"""Order statistics, clusters and densities that come from counts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import accumulate as A
from gridweave.operators import clusters as K
from gridweave.operators import shapes as H

STACK = "image_id long, j int, i int, c int, v double"


def test_large_cell(spark):
    """One cell of a million samples: ranks are right and no task has more than a part of it."""
    n = 1_000_000
    px = spark.range(n).select(F.col("id").alias("image_id"), F.lit(0).alias("j"), F.lit(0).alias("i"), F.lit(0).alias("c"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    few = spark.createDataFrame([(k, 0, 1, 0, v) for k, v in enumerate([5.0, 1.0, 4.0])] + [(9, 0, 1, 0, None), (9, 0, 2, 0, None)], STACK)
    got = {r.i: r for r in A.accumulate_many(px.unionByName(few), ["medv", "med", "q10", "iqd", "cnt"]).collect()}
    assert (got[0].medv, got[0].med, got[0].q10, got[0].iqd, got[0].cnt) == ((n - 1) / 2, n // 2, 100000, 499999, n)
    assert (got[1].medv, got[1].med, got[1].q10, got[1].iqd) == (4.0, 4.0, 1.0, 4.0) and 2 not in got
    ranked = A.accumulated(px, ["medv"], ("j", "i"))
    plan = ranked._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "median" not in plan and "percentile" not in plan


def test_extrema_and_lse(spark):
    rows = [(k, 0, 0, 0, v) for k, v in ((3, 1.0), (5, 0.0), (7, 0.0), (8, 2.0), (9, 2.0))] + [(1, 0, 1, 0, 1000.0), (2, 0, 1, 0, 1000.0)]
    px = spark.createDataFrame(rows, STACK)
    at = lambda op: {r.i: r.v for r in A.accumulate(px, op).collect()}
    assert at("pmin") == {0: 1.0, 1: 0.0} and at("pmax") == {0: 3.0, 1: 0.0}
    assert math.isclose(at("lse")[1], 1000.0)


def cost(x, medians):
    return np.abs(x - np.median(x)).sum() if medians else ((x - x.mean()) ** 2).sum()


@pytest.mark.parametrize("medians", [False, True])
def test_runs_are_best(medians):
    """Against all ways to cut the sorted samples."""
    rng = random.Random(3)
    for _ in range(40):
        x = np.sort([rng.choice([rng.randint(0, 6), rng.randint(20, 30), rng.gauss(10, 3)]) for _ in range(rng.randint(3, 11))]).astype(float)
        v, n = np.unique(x, return_counts=True)
        for k in range(1, min(4, len(v)) + 1):
            first = K.weighted_clusters(v, n.astype(float), k, medians)
            have = sum(cost(np.repeat(v[a:b], n[a:b]), medians) for a, b in zip(first, [*first[1:], len(v)]))
            want = min(sum(cost(x[a:b], medians) for a, b in zip((0, *cut), (*cut, len(x)))) for cut in itertools.combinations(range(1, len(x)), k - 1))
            assert math.isclose(have, want, abs_tol=1e-9), (x, k)


def brute_modes(h, epsilon):
    size, n = len(h), sum(h)
    e, kind = {}, {}
    for a in range(size):
        for b in range(a, size):
            r, p = sum(h[a : b + 1]) / n, (b - a + 1) / size
            e[a, b] = 0.0 if p == 1 else (r * math.log(r / p) if r else 0.0) + ((1 - r) * math.log((1 - r) / (1 - p)) if r < 1 else 0.0)
            kind[a, b] = 0 if e[a, b] < math.log(size * (size + 1) / (2 * epsilon)) / n else 2 if r >= p else 1
    inside = lambda s, t: t[0] <= s[0] and s[1] <= t[1]
    good = [t for t in kind if kind[t] == 2 and not any(kind[s] == 1 and inside(s, t) for s in kind)]
    return [t for t in good if not any(s != t and (inside(s, t) and e[s] > e[t] or inside(t, s) and e[s] >= e[t]) for s in good)]


def test_modes():
    rng = random.Random(8)
    for _ in range(60):
        h = np.array([rng.choice([0, 0, 1, 2, rng.randint(0, 60)]) for _ in range(rng.randint(2, 14))])
        if h.sum():
            have = K.modes(h, 1.0)
            assert [(a, b) for a, b, _ in have] == brute_modes(h.tolist(), 1.0), h
            assert all(f <= 1.0 + 1e-9 for *_, f in have)
    assert [(a, b) for a, b, _ in K.modes(np.array([0, 2, 90, 80, 1, 0, 0, 0, 0, 0, 40, 1, 0]), 1.0)] == [(2, 3), (10, 10)]


def test_clusters(spark):
    rng = random.Random(1)
    two = [rng.gauss(0, 1) for _ in range(300)] + [rng.gauss(60, 1) for _ in range(200)]
    rows = [(k, 0, 0, 0, v) for k, v in enumerate(two)] + [(0, 0, 1, 0, 4.0), (1, 0, 1, 0, None), (2, 0, 1, 0, float("nan")), (3, 0, 2, 0, float("inf"))] + [(k, 0, 3, 0, 7.0) for k in range(500)]
    px = spark.createDataFrame(rows, STACK)
    for kind, precision in (("kmeans", 5.0), ("kmedians", 5.0), ("contrario", 1.0)):
        got = {}
        for r in K.cluster(px, kind, precision, step=0.5 if kind != "contrario" else 5.0).collect():
            got.setdefault(r.i, {})[r.c] = r.v
        assert set(got) == {0, 1, 3} and all(set(x) == set(range(8)) for x in got.values())
        assert got[0][0] == 2.0 and abs(got[0][1]) < 1 and abs(got[0][2] - 60) < 1 and got[0][3] is None, (kind, got[0])
        if kind != "contrario":
            assert (got[1][0], got[1][1]) == (1.0, 4.0)
            assert (got[3][0], got[3][1]) == (1.0, 7.0)
    assert K.cluster(px.limit(0), "kmedians", 1.0).count() == K.cluster(px.limit(0), "contrario", 1.0).count() == 0
    with pytest.raises(ValueError):
        K.cluster(px, "other", 1.0)


def test_trapezoid(spark):
    cell = lambda *v: spark.createDataFrame([("a", k // 2, k % 2, 0, x) for k, x in enumerate(v)], "image_id string, j int, i int, c int, v double")
    mass = lambda px, n, lo, hi: {r.bin: r.mass for r in H.continuous_histogram(px, n, lo, hi).collect()}
    assert {k: round(v, 12) for k, v in mass(cell(0.0, 1.0, 2.0, 3.0), 3, 0.0, 3.0).items()} == {0: 0.25, 1: 0.5, 2: 0.25}
    assert {k: round(v, 12) for k, v in mass(cell(0.0, 0.0, 2.0, 2.0), 4, 0.0, 2.0).items()} == {0: 0.25, 1: 0.25, 2: 0.25, 3: 0.25}
    assert mass(cell(1.0, 1.0, 1.0, 1.0), 4, 0.0, 2.0) == {2: 1.0} and mass(cell(1.0, None, 1.0, 1.0), 4, 0.0, 2.0) == {}
    d = {r.bin: r.density for r in H.density_by_jumps(cell(0.0, 10.0, 20.0, 40.0), 41, 0.0, 40.0).collect()}
    assert all(math.isclose(d[k], 2 / 50 * min(1, (k + 1) / 10), abs_tol=1e-12) for k in range(20)) and math.isclose(d[40], 0, abs_tol=1e-12)
    assert {r.density for r in H.density_by_jumps(cell(0.0, 0.0, 20.0, 40.0), 41, 0.0, 40.0).collect()} == {0.0}


def test_similarity_and_norms(spark):
    """Against numpy, with a missing pixel, flat squares, an image like itself and the greatest error."""
    import numpy as np

    from gridweave.operators import statistics as S

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 256, (2, 7, 9)).astype(float)
    a[:4, :4] = b[:4, :4] = 50.0
    a[6, 8] = np.nan
    table = lambda v: spark.createDataFrame([("p", j, i, 0, None if np.isnan(v[j, i]) else float(v[j, i])) for j in range(7) for i in range(9)], "image_id string, j int, i int, c int, v double")
    ssim, uiqi = [], []
    known = ~np.isnan(a)
    for j in range(7):
        for i in range(9):
            if not known[j, i]:
                continue
            box = (slice(max(0, j - 1), j + 2), slice(max(0, i - 1), i + 2))
            x, y = a[box][known[box]], b[box][known[box]]
            cov = ((x - x.mean()) * (y - y.mean())).mean()
            ssim.append((2 * x.mean() * y.mean() + 2.55**2) * (2 * cov + 7.65**2) / ((x.mean() ** 2 + y.mean() ** 2 + 2.55**2) * (x.var() + y.var() + 7.65**2)))
            if x.var() + y.var() > 0:
                uiqi.append(4 * cov * x.mean() * y.mean() / ((x.mean() ** 2 + y.mean() ** 2) * (x.var() + y.var())))
    r = S.similarity(table(a), table(b), 1).first()
    assert np.isclose(r.ssim, np.mean(ssim)) and np.isclose(r.uiqi, np.mean(uiqi))
    r = S.similarity(table(b), table(b), 1).first()
    assert np.isclose(r.ssim, 1) and np.isclose(r.uiqi, 1)
    e = np.abs(a - b)[known]
    for p, want in ((1, e.mean()), (2.5, (e**2.5).mean() ** 0.4), (float("inf"), e.max())):
        assert np.isclose(S.error_norm(table(a), p, table(b)).first().error, want)
    assert np.isclose(S.error_norm(table(b), 2).first().error, np.sqrt((b**2).mean()))


def test_random_sample_of_cells(spark):
    from gridweave.operators.accumulate import accumulate

    px = spark.createDataFrame([(k, j, 0, 0, float(k)) for k in range(5) for j in range(400)] + [(9, 0, 0, 0, None)], "image_id int, j int, i int, c int, v double")
    got = {r.j: r.v for r in accumulate(px, "rnd").collect()}
    assert len(got) == 400 and got == {r.j: r.v for r in accumulate(px.repartition(7), "rnd").collect()}
    assert all(50 < sum(v == k for v in got.values()) < 115 for k in range(5))
