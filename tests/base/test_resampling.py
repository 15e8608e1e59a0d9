import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions.random import rand_col
from gridweave.operators import fields as D
from gridweave.operators import pairs as R
from gridweave.operators import transforms as X
from gridweave.operators import warps as W
from tests.base.test_operators import grid, image

PIXELS = "image_id string, j int, i int, c int, v double"


def test_transform_round_trip(spark):
    a = np.random.default_rng(1).normal(size=(3, 4))
    px = image(spark, a.tolist())
    f = X.dft2(px)
    want = np.fft.fft2(a)
    for r in f.collect():
        assert abs((want.real, want.imag)[r.c][r.j, r.i] - r.v) < 1e-9
    back = {(r.j, r.i): r.v for r in X.dft2(f, inverse=True).where("c = 0").collect()}
    assert all(abs(back[j, i] - a[j, i]) < 1e-9 for j in range(3) for i in range(4))
    e = a - a.mean()
    for r in X.autocorr(px).collect():
        assert abs(r.v - (e * np.roll(e, (-r.j, -r.i), (0, 1))).sum()) < 1e-9


def test_missing_is_zero(spark):
    px = image(spark, [[1.0, None], [2.0, 3.0]]).where("v is not null")
    assert {(r.j, r.i): round(r.v, 9) for r in X.dft2(px).where("c = 0").collect()} == {(0, 0): 6.0, (0, 1): 0.0, (1, 0): -4.0, (1, 1): 2.0}


def test_registration(spark):
    a = np.add.outer(np.sin(np.arange(24) / 3), np.cos(np.arange(24) / 4)) * 10
    whole = image(spark, a.tolist())
    moved = whole.selectExpr("image_id", "j + 3 AS j", "i + 5 AS i", "c", "v").where("j < 24 and i < 24")
    assert X.register_translation(whole, moved, 3) == (5, 3)


def test_nearest_brute(spark):
    rng = np.random.default_rng(3)
    known = sorted({(int(j), int(i)) for j, i in rng.integers(0, 9, (8, 2))})
    px = spark.createDataFrame([("a", j, i, 0, float(10 * j + i)) for j, i in known], PIXELS)
    have = {(r.j, r.i): (r.d2, r.nj, r.ni, r.v) for r in D.nearest(px, 9, 9).collect()}
    want = {(j, i): min(((j - y) ** 2 + (i - x) ** 2, y, x, float(10 * y + x)) for y, x in known) for j in range(9) for i in range(9)}
    assert have == want
    assert D.nearest(px.where("v < 0"), 9, 9).count() == 0


def test_signed_distance(spark):
    px = image(spark, [[0.0, 0.0, 1.0, 1.0]])
    assert grid(D.signed_distance(px, 4, 1)) == [[2.0, 1.0, -1.0, -2.0]]
    assert grid(D.signed_distance(px, 4, 1, 1.5)) == [[1.5, 1.0, -1.0, -1.5]]


def test_warp_identity_and_shift(spark):
    px = image(spark, [[1.0, 2.0, 4.0], [3.0, 5.0, 9.0]])
    field = px.selectExpr("image_id", "j", "i", "0.5D AS dx", "0.0D AS dy")
    assert grid(W.warp(px, field)) == [[1.5, 3.0, None], [4.0, 7.0, None]]
    assert grid(W.homwarp(px, [1, 0, 0, 0, 1, 0, 0, 0, 1], 3, 2)) == grid(px)
    assert grid(W.upsa(px, 1)) == [[1.0, 2.0]]
    assert grid(W.redim(px, 2)) == [[1.0, 2.0], [4.0, 3.0], [5.0, 9.0]]


def test_unalpha(spark):
    rows = [(k, 0, 0, c, 1.0) for k, n in (("g", 1), ("ga", 2), ("rgb", 3), ("rgba", 4)) for c in range(n)]
    left = W.unalpha(spark.createDataFrame(rows, PIXELS)).groupBy("image_id").count().collect()
    assert {r.image_id: r["count"] for r in left} == {"g": 1, "ga": 1, "rgb": 3, "rgba": 3}


def test_jacobian(spark):
    flow = image(spark, [[0.0] * 5] * 5).selectExpr("image_id", "j", "i", "2.0D * i + j AS p", "3.0D * j - i AS q")
    r = D.flow_jacobian(flow).where("i = 2 and j = 2").first()
    assert (r.px, r.py, r.qx, r.qy, r.div, r.curl, r.det) == (2.0, 1.0, -1.0, 3.0, 5.0, -2.0, 7.0)


def test_pairs(spark):
    segments = spark.createDataFrame([(0.2, 0.0, 1.0, 1.0), (5.0, 5.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    heights = image(spark, [[7.0, 0.0], [0.0, 9.0]])
    assert [(r.z1, r.z2) for r in R.elevate(segments, heights, heights).collect()] == [(7.0, 9.0)]
    assert R.segments_in_mask(segments, heights).count() == 2  # one end is enough
    matches = spark.createDataFrame([(1, 10, 1.0), (1, 11, 4.0), (2, 10, 3.0), (2, 12, 3.1), (3, 9, 2.0)], "`from` int, `to` int, d double")
    assert sorted((r["from"], r.to) for r in R.second_best(matches, 0.8).collect()) == [(1, 10), (3, 9)]
    assert R.match_triplets(matches.where("`from` = 3"), matches).count() == 1


def test_geomedian(spark):
    points = spark.createDataFrame([("g", 0.0, 0.0), ("g", 2.0, 0.0), ("g", 0.0, 2.0), ("g", 2.0, 2.0), ("one", 5.0, 6.0)], "g string, x double, y double")
    got = {r.g: (round(r.cx, 6), round(r.cy, 6)) for r in R.geomedian(points, "g").collect()}
    assert got == {"g": (1.0, 1.0), "one": (5.0, 6.0)}


@pytest.mark.parametrize("kind, mean", [("u", 0.5), ("n", 0.0), ("e", 1.0), ("l", 0.0), ("s", 0.0)])
def test_random(spark, kind, mean):
    assert abs(spark.range(20000).select(rand_col(kind, 5).alias("x")).agg(F.avg("x")).first()[0] - mean) < 0.05
