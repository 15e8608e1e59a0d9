"""Inverse fields, matching by scales, harmonic fills, models by samples, keypoints and text matrices against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import descriptors as M
from gridweave.operators import motion as O
from gridweave.operators import pairs as R
from gridweave.operators import regions as G
from gridweave.operators import shapes as H
from gridweave.operators import warps as W
from gridweave.sources import rasters

PX = "image_id string, j int, i int, c int, v double"


def table(spark, *pictures):
    """Pictures as arrays j, i or j, i, c; nan is no row."""
    rows = []
    for k, p in enumerate(pictures):
        p = p if p.ndim == 3 else p[..., None]
        rows += [("abcdef"[k], j, i, c, float(p[j, i, c])) for j, i, c in np.ndindex(p.shape) if not np.isnan(p[j, i, c])]
    return spark.createDataFrame(rows, PX)


def smooth(rng, h, w, times=3):
    x = rng.normal(0, 100, (h, w))
    for _ in range(times):
        x = (x + np.roll(x, 1, 0) + np.roll(x, 1, 1) + np.roll(x, -1, 0) + np.roll(x, -1, 1)) / 5
    return x


def test_inverse_of_a_warp(spark):
    """A field of slow waves and its inverse cancel within a bound away from the border; rounds end by themselves."""
    h, w = 40, 50
    u = lambda x, y: (2 * np.sin(y / 9) + x / 40, 1.5 * np.cos(x / 8) - y / 50)
    rows = [("a", j, i, *map(float, u(i, j))) for j in range(h) for i in range(w)]
    field = spark.createDataFrame(rows, "image_id string, j int, i int, dx double, dy double")
    worst = 0.0
    for r in W.invert_field(field, 1e-4).collect():
        x, y = r.i + r.dx, r.j + r.dy
        if 3 < x < w - 4 and 3 < y < h - 4:
            ux, uy = u(x, y)
            worst = max(worst, math.hypot(r.dx + ux, r.dy + uy))
    assert worst < 0.02
    holes = field.where("not (i between 20 and 22 and j between 10 and 12)").withColumn("dx", F.when(F.col("i") > 0, F.col("dx")))
    got = W.invert_field(holes, 1e-3).collect()
    assert len(got) == h * w - 9 and any(r.dx is None for r in got) and any(r.dx is not None for r in got)
    assert W.invert_field(field.limit(0)).count() == 0


def window(x, j, i):
    return x[j, i] if 0 <= j < x.shape[0] and 0 <= i < x.shape[1] else 0.0


def plain_match(a, b, r, scales, median, cost):
    """The same search by loops over one channel."""
    half = lambda x: np.array([[np.mean(x[2 * j : 2 * j + 2, 2 * i : 2 * i + 2]) for i in range(-(-x.shape[1] // 2))] for j in range(-(-x.shape[0] // 2))])
    if scales > 1:
        d = 2 * plain_match(half(a), half(b), r, scales - 1, median, cost)[..., :2].repeat(2, 0).repeat(2, 1)[: a.shape[0], : a.shape[1]]
        m = np.zeros_like(d)
        for j, i in np.ndindex(a.shape):
            near = [d[y, x] for y in range(max(0, j - median), min(a.shape[0], j + median + 1)) for x in range(max(0, i - median), min(a.shape[1], i + median + 1))]
            m[j, i] = min(near, key=lambda p: sum(math.hypot(*(p - q)) for q in near))
        d = m
    else:
        d = np.zeros((*a.shape, 2))
    out = np.zeros((*a.shape, 3))
    for j, i in np.ndindex(a.shape):
        best = None
        for x, y in O.NEAR:
            dx, dy = int(d[j, i, 0]) + x, int(d[j, i, 1]) + y
            total = 0.0
            for oy in range(-r, r + 1):
                for ox in range(-r, r + 1):
                    p, q = window(a, j + oy, i + ox), window(b, j + oy + dy, i + ox + dx)
                    total += (p - q) ** 2 if cost == "squares" else (p > window(a, j, i)) != (q > window(b, j + dy, i + dx))
            if best is None or total < best[2]:
                best = (dx, dy, total)
        out[j, i] = best
    return out


@pytest.mark.parametrize("cost", ["squares", "sign"])
def test_scales_against_loops(spark, cost):
    rng = np.random.default_rng(6)
    a = np.rint(smooth(rng, 21, 26))
    b = np.roll(a, (2, -3), (0, 1))
    want = plain_match(a, b, 1, 3, 1, cost)
    got = {(r.j, r.i): (r.dx, r.dy, r.cost) for r in O.block_match_scales(table(spark, a), table(spark, b), 1, 3, 1, cost).collect()}
    assert len(got) == a.size
    assert sum(np.allclose(got[k], want[k], atol=1e-6) for k in got) == a.size


@pytest.mark.parametrize("cost", ["squares", "census"])
def test_far_move(spark, cost):
    """A move of 13 pixels is found with five candidates a scale."""
    rng = np.random.default_rng(2)
    whole = smooth(rng, 100, 140, 40)
    a, b = whole[:, 20:120], whole[:, 7:107]
    found = [(r.dx, r.dy) for r in O.block_match_scales(table(spark, a), table(spark, b), 4, 5, 2, cost).collect() if 20 <= r.i < 80 and 20 <= r.j < 80]
    assert sum(m == (13, 0) for m in found) > 0.9 * len(found)


def test_match_channels_and_empty(spark):
    rng = np.random.default_rng(1)
    two = np.rint(np.stack([smooth(rng, 20, 20), smooth(rng, 20, 20)], 2))
    px = table(spark, two)
    assert {(r.dx, r.dy, r.cost) for r in O.block_match_scales(px, px, 1, 2).collect()} == {(0, 0, 0.0)}
    assert O.block_match_scales(px.limit(0), px.limit(0), 1, 2).count() == 0
    with pytest.raises(ValueError):
        O.block_match_scales(px, px, 1, 1, cost="other")


def test_harmonic(spark):
    """A hole of 64 x 64 pixels in a harmonic picture comes back within 1e-3; so do holes at the border and single ones."""
    y, x = np.mgrid[0:96, 0:90].astype(float)
    true = (x * x - y * y) / 40 + x * y / 60 + 3 * x
    p = true.copy()
    p[16:80, 12:76] = np.nan
    p[3, 4] = p[90, 80] = np.nan
    got = {(r.j, r.i): r.v for r in G.harmonic(table(spark, p)).where("image_id = 'a'").collect()}
    assert len(got) == p.size
    assert max(abs(got[k] - true[k]) for k in got) < 1e-3
    q = np.full((20, 20), np.nan)
    q[0, 0], q[19, 19], q[0, 19] = 1.0, 3.0, 1.0
    v = {(r.j, r.i): r.v for r in G.harmonic(table(spark, q)).collect()}
    for (j, i), u in v.items():
        if np.isnan(q[j, i]):
            near = [v[k] for k in ((j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)) if k in v]
            assert abs(u - np.mean(near)) < 1e-4
    assert G.harmonic(table(spark, q).limit(0)).count() == 0
    only = G.harmonic(table(spark, np.array([[1.0, 2.0]])).withColumn("v", F.lit(None).cast("double"))).collect()
    assert [r.v for r in only] == [None, None]


def camera_pairs(rng, n):
    """Pairs of one scene in two views, with their fundamental matrix."""
    x = np.column_stack([rng.uniform(-2, 2, (n, 2)), rng.uniform(4, 9, n)])
    t, angle = np.array([1.0, 0.2, 0.1]), 0.2
    turn = np.array([[math.cos(angle), 0, math.sin(angle)], [0, 1, 0], [-math.sin(angle), 0, math.cos(angle)]])
    k = np.array([[300.0, 0, 200], [0, 300, 150], [0, 0, 1]])
    p, q = x @ k.T, (x @ turn.T + t) @ k.T
    cross = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
    f = np.linalg.inv(k).T @ cross @ turn @ np.linalg.inv(k)
    return np.column_stack([p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]]), f / np.linalg.norm(f)


def alike(a, b):
    return min(np.abs(a - b).max(), np.abs(a + b).max())


def test_models(spark):
    """Planted models among 60 % outliers, and what each solver gives for exact rows."""
    rng = np.random.default_rng(5)
    h = np.array([[1.1, 0.1, 20], [-0.2, 0.9, 5], [0.0004, -0.0003, 1]])
    x = rng.uniform(0, 300, (500, 2))
    z = np.column_stack([x, np.ones(500)]) @ h.T
    rows = np.column_stack([x, z[:, :2] / z[:, 2:]])
    assert alike(M.homography_fit(rows[:4]), h / np.linalg.norm(h)) < 1e-6 and M.homography_residual(h, rows).max() < 1e-9
    rows[:300, 2:] = rng.uniform(0, 400, (300, 2))
    points = spark.createDataFrame(rows.tolist(), "x1 double, y1 double, x2 double, y2 double").repartition(4)
    model, n = M.ransac(points, points.columns, M.homography_fit, M.homography_residual, 4, 120, 0.01)
    assert n >= 200 and alike(model, h / np.linalg.norm(h)) < 1e-5
    assert M.inliers(points, points.columns, model, M.homography_residual, 0.01).count() == n
    assert M.ransac(points, points.columns, M.homography_fit, M.homography_residual, 4, 120, 0.01, least=400)[0] is None
    rows, f = camera_pairs(rng, 1500)
    assert min(alike(m, f) for m in M.fundamental_fit(rows[:7])) < 1e-5 and alike(M.fundamental_fit(rows[:12])[0], f) < 1e-6
    assert all(abs(np.linalg.det(m)) < 1e-12 for m in M.fundamental_fit(rows[:7]))
    rows[:900, 2:] += rng.uniform(-80, 80, (900, 2))
    points = spark.createDataFrame(rows.tolist(), "x1 double, y1 double, x2 double, y2 double").repartition(4)
    model, n = M.ransac(points, points.columns, M.fundamental_fit, M.epipolar_residual, 7, 4000, 0.01)
    assert n >= 600 and alike(model, f) < 1e-4
    far = {(r.x1, r.y1): r.error for r in R.epipolar_error(points, f.ravel().tolist()).collect()}
    assert np.allclose([far[a, b] for a, b, *_ in rows], M.epipolar_residual(f, rows))
    assert M.homography_fit(np.zeros((4, 4))) is None and M.fundamental_fit(np.ones((7, 4))) is None
    assert M.affine_is_sound(np.array([[1.0, 0, 3], [0, 1, 4]])) and not M.affine_is_sound(np.array([[-1.0, 0, 3], [0, 1, 4]]))
    assert M.ransac(points, points.columns, M.affine_fit, M.affine_residual, 3, 30, 1.0, accept=lambda m: False) == (None, 0)


def test_keypoints(spark):
    schema = "id long, x double, y double, descr array<float>"
    kp = lambda rows: spark.createDataFrame(rows, schema)
    chain = kp([(k, 5.0 * k, 0.0, [1.0]) for k in range(1, 4)])
    assert sorted(r.id for r in M.dedup_keypoints(chain, 6.0, 1.0).collect()) == [1, 3]
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.uniform(0, 40, 2)), [float(rng.integers(0, 3))]) for k in range(250)]
    kept = []
    for k, x, y, d in sorted(rows, reverse=True):
        if not any(math.hypot(x - a, y - b) < 3 and abs(d[0] - e[0]) < 1.5 for _, a, b, e in kept):
            kept.append((k, x, y, d))
    odd = [(900, 1.0, 1.0, None), (901, 1.0, 1.0, [None])]
    assert sorted(r.id for r in M.dedup_keypoints(kp(rows + odd), 3.0, 1.5).collect()) == sorted(k for k, *_ in kept) + [900, 901]
    assert M.dedup_keypoints(chain.limit(0), 6.0, 1.0).count() == 0
    with_null = kp([(1, 0.0, 0.0, [1.0, 2.0]), (2, 0.0, 0.0, None), (3, 0.0, 0.0, [None, 1.0])])
    assert [(r["from"], r["to"]) for r in M.match_nearest(with_null, with_null, 9.0).collect()] == [(1, 1)]
    assert M.match_all(with_null, with_null, 9.0).count() == 1


def test_matrix_text(spark, tmp_path):
    two = np.arange(24.0).reshape(3, 4, 2) / 7
    two[1, 2, 0] = np.nan
    px = table(spark, two, np.array([[1e300, -0.5]]))
    rasters.write_matrix_text(px, f"{tmp_path}/m")
    back = rasters.read_matrix_text(spark, f"{tmp_path}/m").where("v is not null")
    assert sorted(back.select("image_id", "j", "i", "c", "v").collect()) == sorted(px.select("image_id", "j", "i", "c", "v").collect())
    (tmp_path / "plain.txt").write_text("1 2,3\n\n4\t nan 6e1\n")
    plain = [(r.image_id, r.j, r.i, r.c, r.v) for r in rasters.read_matrix_text(spark, f"{tmp_path}/plain.txt").orderBy("j", "i").collect()]
    assert plain == [("plain.txt", 0, 0, 0, 1.0), ("plain.txt", 0, 1, 0, 2.0), ("plain.txt", 0, 2, 0, 3.0), ("plain.txt", 1, 0, 0, 4.0), ("plain.txt", 1, 1, 0, None), ("plain.txt", 1, 2, 0, 60.0)]


def test_locate(spark):
    flat = np.zeros((12, 12))
    flat[5, 6] = 9.0
    needle = np.array([[0.0, 0.0], [0.0, 9.0]])
    hay = table(spark, flat, np.zeros((5, 5)))
    assert [(r.image_id, r.i, r.j) for r in H.locate(table(spark, needle), hay).collect()] == [("a", 5, 4)]
    null = table(spark, needle).withColumn("v", F.when(F.col("i") + F.col("j") > 0, F.col("v")))
    assert [(r.i, r.j) for r in H.locate(null, hay).collect()] == [(5, 4)]
    assert H.locate(table(spark, np.array([[77.0]])), hay).count() == 0 and H.locate(null.where("v is null"), hay).count() == 0
