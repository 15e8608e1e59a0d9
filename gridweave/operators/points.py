"""Points ``id, x, y[, z]``, segments and keypoints: rasterising, mapping, filtering and matching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators.blocks import meet, nearest, numbers, tiled


def rasterize(points: DataFrame, x0: float, xf: float, y0: float, yf: float, w: int, h: int, value: str = "z") -> DataFrame:
    """Average, least, greatest value and number of points in each cell of a w x h grid; points beyond the border count at it."""
    at = lambda k, a, b, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(k) - a) * n / (b - a)))).cast("int")
    return points.groupBy(at("y", y0, yf, h).alias("j"), at("x", x0, xf, w).alias("i")).agg(F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))


def map_points(points: DataFrame, matrix: list[float]) -> DataFrame:
    """Move by a 3x3 homography, row by row; points at infinity become null."""
    a, b, c, d, e, f, g, h, k = map(F.lit, matrix)
    x, y = F.col("x"), F.col("y")
    z = g * x + h * y + k
    return points.withColumns({"x": F.try_divide(a * x + b * y + c, z), "y": F.try_divide(d * x + e * y + f, z)})


def segments_longer(segments: DataFrame, least: float) -> DataFrame:
    return segments.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > least)


def match_window(a: DataFrame, b: DataFrame, rx: float, ry: float, t: float) -> DataFrame:
    """For each keypoint of a the nearest descriptor among those of b within rx, ry, if closer than t.

    Keypoints of a in a tile are compared in blocks with those of b in and around it.
    """

    def within(x, y):
        (ax, ay), (bx, by) = numbers(x, "x", "y"), numbers(y, "x", "y")
        return lambda part: (np.abs(ax[part, None] - bx) <= rx) & (np.abs(ay[part, None] - by) <= ry)

    own, other, key = tiled(a, b, rx, ry)
    kind = lambda d: d.schema["id"].dataType.simpleString()
    found = meet(own, other, key, nearest(within, t), f"`from` {kind(own)}, `to` {kind(other)}, d double")
    return found.groupBy("from").agg(F.min(F.struct("d", "to")).alias("m")).select("from", "m.to", "m.d")


def track_points(a: DataFrame, b: DataFrame, distance: float) -> DataFrame:
    """Nearest point of b within ``distance`` of each of a, ties to the lower id; an equi join over cells."""
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    own = a.select(F.col("id").alias("from"), F.col("x").alias("ax"), F.col("y").alias("ay")).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    own = own.withColumn("ci", F.floor(F.col("ax") / distance) + F.col("dx")).withColumn("cj", F.floor(F.col("ay") / distance) + F.col("dy"))
    other = b.select(F.col("id").alias("to"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / distance).alias("ci"), F.floor(F.col("y") / distance).alias("cj"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    near = own.join(other, ["ci", "cj"]).withColumn("d", d).where(F.col("d") <= distance)
    return near.groupBy("from").agg(F.min(F.struct("d", "to")).alias("m")).select("from", "m.to", "m.d")


def gradient_edges(px: DataFrame) -> DataFrame:
    """Absolute differences along grid edges by gray level: the lower end adds, the upper one ends it; cum is the sum at each level."""
    row, column = Window.partitionBy("image_id", "j", "c").orderBy("i"), Window.partitionBy("image_id", "i", "c").orderBy("j")
    after = lambda w: F.first("v").over(w.rangeBetween(1, 1))
    d = px.select("image_id", "v", after(row).alias("right"), after(column).alias("below"))
    d = d.select("image_id", "v", F.explode(F.array("right", "below")).alias("u")).where("u is not null and v is not null")
    jump = F.abs(F.col("u") - F.col("v"))
    ends = d.select("image_id", F.explode(F.array(F.struct(F.least("u", "v").alias("level"), jump.alias("w")), F.struct(F.greatest("u", "v").alias("level"), (-jump).alias("w")))).alias("e"))
    sums = ends.groupBy("image_id", F.col("e.level").alias("level")).agg(F.sum("e.w").alias("w"))
    return sums.withColumn("cum", F.sum("w").over(Window.partitionBy("image_id").orderBy("level")))
