"""Programs on tiles against plain loops, on an image of several tiles with holes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import fields as D
from gridweave.operators import motion as O
from gridweave.operators import neighbours as N
from gridweave.operators import tiles

W, HEIGHT = 90, 70


@pytest.fixture(scope="module")
def picture():
    """Values by place; None is a null, an absent place has no row."""
    rng = np.random.default_rng(4)
    out = {(j, i): float(rng.integers(-50, 50)) for j in range(HEIGHT) for i in range(W) if rng.random() > 0.05}
    for k in list(out)[::37]:
        out[k] = None
    return out


@pytest.fixture(scope="module")
def px(spark, picture):
    return spark.createDataFrame([("a", j, i, 0, v) for (j, i), v in picture.items()] + [("b", 0, 0, 0, 3.0), ("c", 5, 200, 1, None)], "image_id string, j int, i int, c int, v double").cache()


def of(df, image_id="a", name="v"):
    return {(r["j"], r["i"]): r[name] for r in df.where(F.col("image_id") == image_id).collect()}


def near(picture, j, i, offsets):
    return [((x, y), picture[j + y, i + x]) for x, y in offsets if picture.get((j + y, i + x)) is not None]


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9)), (k, a[k], b[k])


@pytest.mark.parametrize("name", ["square", "cross", "disk6.3", "hrec9", "vrec4"])
def test_morphology(px, picture, name):
    e = N.element(name)
    back = [(-x, -y) for x, y in e]
    fold = lambda f, o: {k: f([v for _, v in near(picture, *k, o)]) if near(picture, *k, o) else None for k in picture}
    same(of(N.erode(px, e)), fold(min, e))
    same(of(N.dilate(px, e)), fold(max, back))
    same(of(N.median_filter(px, e)), fold(np.median, e))
    assert of(N.erode(px, e), "b") == {(0, 0): 3.0} and of(N.erode(px, e), "c") == {(5, 200): None}


def test_kernels(px, picture):
    plain = {(x, y): 1.0 + x + 2 * y + x * y for x in range(-2, 3) for y in range(-2, 3)}
    large = N.kernel("cauchy", 2.0, 12)
    for k in (plain, large, N.kernel("gauss", 2.0), N.kernel("square", 5.0)):
        want = {}
        for at in picture:
            u = [(k[o], v) for o, v in near(picture, *at, k)]
            want[at] = sum(w * v for w, v in u) / sum(w for w, _ in u) if u and sum(w for w, _ in u) else None
        same(of(N.convolve(px, k)), want)


@pytest.mark.parametrize("boundary", ["periodic", "symmetric"])
def test_boundaries(spark, boundary):
    """A kernel wider than the image goes round it more than once."""
    v = np.arange(12.0).reshape(3, 4) ** 2
    px = spark.createDataFrame([("a", j, i, 0, float(v[j, i])) for j in range(3) for i in range(4)], "image_id string, j int, i int, c int, v double")
    k = N.kernel("gauss", 2.0, 5)
    pad = np.pad(v, 5, mode="wrap" if boundary == "periodic" else "symmetric")
    want = {(j, i): sum(w * pad[j + 5 + y, i + 5 + x] for (x, y), w in k.items()) / sum(k.values()) for j in range(3) for i in range(4)}
    same(of(N.blur(px, "gauss", 2.0, boundary, radius=5)), want)
    with pytest.raises(ValueError):
        tiles.extended(px, 1, "other")


def test_diffusion_and_local_width(px, picture):
    now = dict(picture)
    for _ in range(3):
        now = {k: None if now[k] is None else now[k] + 0.15 * sum(v - now[k] for _, v in near(now, *k, [(1, 0), (-1, 0), (0, 1), (0, -1)])) for k in now}
    same(of(D.diffuse(px, 0.15, 3)), now)
    width = lambda j, i: (i % 5) / 4
    sigma = px.where("image_id = 'a' and i > 2").select("image_id", "j", "i", F.lit(0).alias("c"), (F.col("i") % 5 / 4).alias("v"))
    want = {}
    for j, i in picture:
        if i > 2:
            s = width(j, i)
            r = 0 if s < 0.1 else math.ceil(3 * s)
            u = [(1.0 if not r else math.exp(-(x * x + y * y) / (2 * s * s)), v) for (x, y), v in near(picture, j, i, [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1)])]
            want[j, i] = sum(w * v for w, v in u) / sum(w for w, _ in u) if u else None
    same(of(O.local_gaussian(px, sigma)), want)


def test_rows_shuffled(px):
    """Tiles and margins are as many whatever the reach; pixels go through one exchange and no explosion."""
    own = px.withColumn("here", F.lit(True))
    n = {r: tiles.blocks(own, r, ("v",), 64).where("image_id = 'a'").count() for r in (1, 8, 40)}
    assert n[1] <= n[8] <= n[40] <= 9 * 4
    for r in (1, 20):
        plan = N.erode(px, [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1)])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan


def test_numbers_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    px = spark.createDataFrame([("a", 0, i, 0, v) for i, v in enumerate([nan, 1.0, inf, nan, nan, nan])], "image_id string, j int, i int, c int, v double")
    e = N.element("hrec3")
    lo, hi = of(N.erode(px, e)), of(N.dilate(px, e))
    assert [lo[0, k] for k in range(4)] == [1.0, 1.0, 1.0, inf] and math.isnan(lo[0, 4])
    assert math.isnan(hi[0, 0]) and math.isnan(hi[0, 1]) and math.isnan(hi[0, 3])


def test_empty(px):
    none = px.limit(0)
    for out in (N.erode(none, N.element("disk3")), N.blur(none, "gauss", 1.0, "symmetric"), D.diffuse(none, 0.1, 2), N.smooth_structure_tensor(none, 1.0)):
        assert out.count() == 0
