import math
import struct
import zlib

import numpy as np
import pytest

from gridweave.operators import accumulate as A
from gridweave.operators import descriptors
from gridweave.operators import neighbours as N
from gridweave.operators import pixels as P
from gridweave.operators import points as T
from gridweave.operators import statistics as S
from gridweave.sources import rasters
from gridweave.storage import running
from gridweave.streaming.rasterize import latest_cells, rasterize_stream


def image(spark, rows, image_id="a"):
    return spark.createDataFrame([(image_id, j, i, 0, v) for j, r in enumerate(rows) for i, v in enumerate(r)], "image_id string, j int, i int, c int, v double")


def grid(px):
    d = {(r.j, r.i): r.v for r in px.collect()}
    return [[d.get((j, i)) for i in range(max(k[1] for k in d) + 1)] for j in range(max(k[0] for k in d) + 1)]


SMALL = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]


@pytest.mark.parametrize("kind", ["leftright", "topdown", "transpose", "posetrans", "r180"])
def test_flip_twice(spark, kind):
    px = image(spark, SMALL)
    assert grid(P.flip(P.flip(px, kind), kind)) == SMALL


def test_flip_turns(spark):
    px = image(spark, SMALL)
    assert grid(P.flip(P.flip(px, "r90"), "r270")) == SMALL
    assert grid(P.flip(px, "r90")) == [[3.0, 6.0], [2.0, 5.0], [1.0, 4.0]]


@pytest.mark.parametrize("boundary, want", [("nearest", [2.0, 3.0, 3.0]), ("zero", [2.0, 3.0, 0.0]), ("periodic", [2.0, 3.0, 1.0]), ("symmetric", [2.0, 3.0, 3.0]), ("null", [2.0, 3.0, None])])
def test_shift(spark, boundary, want):
    assert grid(P.shift(image(spark, [[1.0, 2.0, 3.0]]), 1, 0, boundary)) == [want]


def test_round_trips(spark, tmp_path):
    px = image(spark, [[1.0, None, 3.5], [4.0, 5.0, 6.0]])
    rasters.write_matrix_text(px, f"{tmp_path}/t")
    assert grid(rasters.read_matrix_text(spark, f"{tmp_path}/t")) == grid(px)
    rasters.write_raster(px, f"{tmp_path}/r", 2)
    assert grid(rasters.read_raster(spark, f"{tmp_path}/r", side=2)) == grid(px)
    part = rasters.read_raster(spark, f"{tmp_path}/r", (1, 0, 3, 1), side=2)
    assert sorted((r.j, r.i, r.v) for r in part.collect()) == [(0, 1, None), (0, 2, 3.5)]
    assert grid(P.untile(P.tileize(px, 2, 2), 2, 2)) == grid(px)


def test_sets(spark):
    px = image(spark, SMALL)
    assert grid(P.lrcat(px, px)) == [r + r for r in SMALL]
    assert grid(P.deinterlace(image(spark, [[1.0], [2.0], [3.0]]))) == [[1.0], [3.0], [2.0]]
    assert P.bayer_parts(px).select("c").distinct().count() == 4
    assert grid(P.autotrim(image(spark, [[None, None], [None, 7.0]]))) == [[7.0]]
    assert grid(P.fill_rows(image(spark, [[None, 1.0, None, 3.0, None]]), 5)) == [[1.0, 1.0, 2.0, 3.0, 3.0]]
    assert grid(P.fill_up(image(spark, [[None], [2.0], [None], [4.0]]), 4)) == [[2.0], [2.0], [4.0], [4.0]]
    assert P.get_bands(px).first().image_id == "a/0" and P.component(px, 1).count() == 0
    assert grid(P.band_slice(image(spark, [[0.0, 9.0]]), px)) == [[1.0, None]]
    assert P.lookup(px, spark.createDataFrame([("a", 0, 1), ("a", 9, 9)], "image_id string, j int, i int"), "null").count() == 2
    assert P.good(image(spark, [[float("nan"), float("inf"), 1.0, None]])).count() == 1


def test_empty(spark):
    px = image(spark, SMALL).limit(0)
    for out in (A.accumulate(px, "sum"), P.flip(px, "r90"), S.histogram(px), N.erode(px, N.element("square")), P.pyramid(px, 2), S.qauto(px)):
        assert out.count() == 0


def test_nulls(spark):
    px = image(spark, [[1.0, None]]).unionByName(image(spark, [[3.0, None]], "b"))
    assert [(r.i, r.v) for r in A.accumulate(px, "avg").collect()] == [(0, 2.0)]
    assert grid(N.dilate(image(spark, [[1.0, None, None]]), N.element("hrec3"))) == [[1.0, 1.0, None]]


def test_neighbours(spark):
    px = image(spark, [[0.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 0.0]])
    assert sum(map(sum, grid(N.opening(px, N.element("cross"))))) == 0
    assert grid(N.tophat(px, N.element("cross")))[1][1] == 9.0
    assert grid(N.census(px))[0][0] == 128.0
    assert grid(N.local_extrema(px))[1][1] == 9.0
    assert {(r.j, r.i): r.xx for r in N.structure_tensor(px, 0).collect()}[(1, 0)] == 81.0
    assert len(N.element("disk2.5")) == 21


def test_statistics(spark):
    a, b = image(spark, [[0.0, 0.0]]), image(spark, [[0.0, 9.0]])
    assert S.transport_distance(a, b, 10, 0, 10).first().distance == pytest.approx(4.5)
    assert T.gradient_edges(image(spark, [[0.0, 3.0]])).orderBy("level").first().cum == 3.0
    assert grid(P.affine2(a, b, 1, 2, 3)) == [[3.0, 21.0]]


def test_stream(spark, tmp_path):
    schema = "x double, y double, z double"
    for k in range(3):
        spark.createDataFrame([(0.1 + k / 3, 0.5, float(k)), (0.9, 0.5, float(k))], schema).write.mode("append").parquet(f"{tmp_path}/in")
    box = dict(x0=0.0, xf=1.0, y0=0.0, yf=1.0, w=4, h=4)
    rasterize_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", **box).awaitTermination(120)
    want = T.rasterize(spark.read.parquet(f"{tmp_path}/in"), **box)
    assert sorted(latest_cells(spark, f"{tmp_path}/out").collect()) == sorted(want.collect())


def test_ransac(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-10, 10, (300, 2))
    matrix = np.array([[1.5, -0.2, 3.0], [0.4, 0.9, -2.0]])
    y = x @ matrix[:, :2].T + matrix[:, 2]
    y[:100] = rng.uniform(-50, 50, (100, 2))
    points = spark.createDataFrame(np.column_stack([x, y]).tolist(), "x1 double, y1 double, x2 double, y2 double").repartition(3)
    model, n = descriptors.ransac(points, points.columns, descriptors.affine_fit, descriptors.affine_residual, 3, 60, 1e-6)
    assert n == 200 and np.allclose(model, matrix)
    assert descriptors.ransac(points.limit(0), points.columns, descriptors.affine_fit, descriptors.affine_residual, 3, 60, 1e-6) == (None, 0)
    line = spark.createDataFrame([(k, float(k), 2.0 * k + 1 if k % 3 else 90.0 - k) for k in range(60)], "id long, x double, y double")
    best = descriptors.ransac_line(line, 30, 1e-6).first()
    assert best.inliers == 40 and math.isclose(-best.a / best.b, 2.0)


def test_positions(spark):
    rows = [(str(k), 0, 0, 0, v) for k, v in enumerate([1.0, 1.1, 0.9, 9.0, 9.2, 8.8])] + [("0", 0, 1, 0, 4.0)]
    px = spark.createDataFrame(rows, "image_id string, j int, i int, c int, v double")
    mean = {r.i: r.v for r in descriptors.frechet(px, 2.0, 3).collect()}
    assert math.isclose(mean[0], 5.0) and mean[1] == 4.0


def test_images(spark, tmp_path):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    body = b"".join(b"\0" + row.tobytes() for row in pixels)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(png)
    px = rasters.read_images(spark, f"{tmp_path}/in")
    assert {(r.j, r.i, r.c): r.v for r in px.collect()} == {(j, i, c): float(pixels[j, i, c]) for j in range(2) for i in range(3) for c in range(3)}
    rasters.write_raster(px, f"{tmp_path}/store", side=2)
    assert [tuple(r) for r in rasters.list_images(spark, f"{tmp_path}/store").collect()] == [("a.png", 3, 2, 3, 18)]


def test_matrix_text_keeps_holes(spark, tmp_path):
    px = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 0, 2, 0, 3.0), ("a", 1, 1, 0, None)], "image_id string, j int, i int, c int, v double")
    rasters.write_matrix_text(px, f"{tmp_path}/t")
    got = {(r.j, r.i): r.v for r in rasters.read_matrix_text(spark, f"{tmp_path}/t").where("v is not null").collect()}
    assert got == {(0, 0): 1.0, (0, 2): 3.0}


def test_running_sums_are_whole(spark):
    rows = [("a" if k % 3 else "b", k * 7919 % 101, 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, one int").repartition(5)
    got = running(df, ["g"], ["v"], "one", "cum").collect()
    assert len(got) == 3000
    for r in got[::97]:
        assert r.cum == sum(g == r.g and v <= r.v for g, v, _ in rows)
