"""Derivatives, diffusion, ranks, distances and nearest pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators import tiles
from gridweave.operators.neighbours import element
from gridweave.operators.pixels import KEYS

_CROSS = [o for o in element("cross") if o != (0, 0)]


def diffuse(px: DataFrame, step: float, n: int) -> DataFrame:
    """n explicit steps of linear diffusion over the known neighbours. A tile with a halo of n pixels does all of them, so there is one exchange whatever n."""

    def run(v: dict, known: dict) -> list:
        x, k = np.where(known["v"], v["v"], 0.0), known["v"]
        for _ in range(n):
            at = lambda a, o: tiles.moved(a, 1, *o)
            gain = sum(np.where(at(k, o), at(x, o) - at(x, (0, 0)), 0.0) for o in _CROSS)
            x, k = np.where(at(k, (0, 0)), at(x, (0, 0)) + step * gain, 0.0), at(k, (0, 0))
        return [(x, k)]

    return tiles.on_tiles(px, n, run)


def sphere_count(px: DataFrame, r: float, vex: float = 1.0) -> DataFrame:
    """Neighbours of a height raster within a sphere of radius r, the centre included."""
    k = int(np.ceil(r))
    disk = [(x, y) for x in range(-k, k + 1) for y in range(-k, k + 1) if x * x + y * y < r * r]

    def run(v: dict, known: dict) -> list:
        own, there = tiles.moved(v["v"], k, 0, 0), tiles.moved(known["v"], k, 0, 0)
        inside = lambda x, y: tiles.moved(known["v"], k, x, y) & (x * x + y * y + ((tiles.moved(v["v"], k, x, y) - own) / vex) ** 2 < r * r)
        return [(sum(inside(*o) for o in disk).astype(float), there)]

    return tiles.on_tiles(px, k, run)


def _centred(v: str, along: str, across: str) -> Column:
    """Half the difference of both neighbours; at a border or hole the pixel itself stands in."""
    by = Window.partitionBy("image_id", across, *(["c"] if v == "v" else [])).orderBy(along).rangeBetween
    near = lambda k: F.coalesce(F.first(v).over(by(k, k)), F.col(v))
    return (near(1) - near(-1)) / 2


def gradient(px: DataFrame) -> DataFrame:
    """Adds gx and gy, centred differences, to each pixel."""
    return px.select(*KEYS, "v", _centred("v", "i", "j").alias("gx"), _centred("v", "j", "i").alias("gy"))


def flow_jacobian(flow: DataFrame) -> DataFrame:
    """Of a field ``image_id, j, i, p, q``: its four derivatives, divergence, curl and determinant."""
    d = flow.select("image_id", "j", "i", _centred("p", "i", "j").alias("px"), _centred("p", "j", "i").alias("py"), _centred("q", "i", "j").alias("qx"), _centred("q", "j", "i").alias("qy"))
    return d.selectExpr("*", "px + qy AS div", "qx - py AS curl", "px * qy - py * qx AS det")


def monodisp(px: DataFrame) -> DataFrame:
    """Pixels of a row that aren't less than the one before them by 1 or more."""
    before = F.lag("v").over(Window.partitionBy("image_id", "j", "c").orderBy("i"))
    return px.withColumn("before", before).where("before is null or v > before - 1").select(*KEYS, "v")


def nearest(px: DataFrame, w: int, h: int) -> DataFrame:
    """For each pixel of a w x h grid the nearest known one: v, its place nj, ni and the squared distance d2; ties to the lesser (nj, ni).

    Along columns by two windows; then within each row, in numpy, at growing horizontal distance until none can be nearer.
    A row or column of an image is one group, bounded by its side. Images without a known pixel give no rows.
    """
    known = px.where("v is not null").select(*KEYS, F.col("v").cast("double").alias("v"))
    grid = known.select("image_id", "c").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    d = grid.join(known, KEYS, "left")
    own = F.when(F.col("v").isNotNull(), F.struct("j", "v"))
    by = Window.partitionBy("image_id", "i", "c").orderBy("j")
    d = d.withColumn("a", F.last(own, True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(own, True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    first = F.when(F.col("b").isNull() | (F.col("j") - F.col("a.j") <= F.col("b.j") - F.col("j")), F.col("a")).otherwise(F.col("b"))
    d = d.withColumn("m", first).select(*KEYS, F.col("m.j").alias("mj"), F.col("m.v").alias("mv"))

    def along(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", ignore_index=True)
        n, j = len(rows), int(rows["j"].iloc[0]) if len(rows) else 0
        mj, mv = rows["mj"].to_numpy(float), rows["mv"].to_numpy(float)
        up = np.where(np.isnan(mj), np.inf, (mj - j) ** 2)
        at = np.arange(n)
        best, src = up.copy(), at.copy()
        for k in range(1, n):
            if best.max() < k * k:
                break
            for s in (-k, k):
                here = at[(at + s >= 0) & (at + s < n)]
                far = up[here + s] + k * k
                old = src[here]
                less = (far < best[here]) | ((far == best[here]) & np.isfinite(far) & ((mj[here + s] < mj[old]) | ((mj[here + s] == mj[old]) & (here + s < old))))
                best[here[less]], src[here[less]] = far[less], here[less] + s
        return pd.DataFrame({"image_id": rows["image_id"], "j": rows["j"], "i": rows["i"], "c": rows["c"], "v": mv[src], "nj": mj[src].astype("int32"), "ni": rows["i"].to_numpy()[src].astype("int32"), "d2": best.astype("int64")})

    kind = px.schema["image_id"].dataType.simpleString()
    return d.groupBy("image_id", "c", "j").applyInPandas(along, f"image_id {kind}, j int, i int, c int, v double, nj int, ni int, d2 bigint")


def fill_nearest(px: DataFrame, w: int, h: int) -> DataFrame:
    return nearest(px, w, h).select(*KEYS, "v")


def distance(mask: DataFrame, w: int, h: int) -> DataFrame:
    """Distance of each pixel of the grid to the nearest one that is set (neither null nor 0)."""
    return nearest(mask.where("v != 0"), w, h).select(*KEYS, F.sqrt("d2").alias("v"))


def signed_distance(mask: DataFrame, w: int, h: int, most: float | None = None) -> DataFrame:
    """Positive outside, negative inside; null where there is no other side; cut at ``most``."""
    inside = mask.where("v != 0").select(*KEYS, F.lit(1.0).alias("v"))
    grid = mask.select("image_id", "c").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    outside = grid.join(inside.select(*KEYS), KEYS, "left_anti").withColumn("v", F.lit(1.0))
    far = nearest(inside, w, h).select(*KEYS, F.sqrt("d2").alias("o"))
    deep = nearest(outside, w, h).select(*KEYS, F.sqrt("d2").alias("n"))
    v = F.when(F.col("o") > 0, F.col("o")).otherwise(-F.col("n"))
    d = grid.join(far, KEYS, "left").join(deep, KEYS, "left")
    return d.select(*KEYS, (v if most is None else F.greatest(F.lit(-most), F.least(F.lit(most), v))).alias("v"))
