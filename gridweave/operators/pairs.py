"""Pairs of points, tracks, residuals and vector samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def point_raster(points: DataFrame, w: int, h: int) -> DataFrame:
    """Number of points x, y nearest to each pixel; those outside are dropped."""
    at = lambda k: F.floor(F.col(k) + 0.5).cast("int")
    return points.select(at("y").alias("j"), at("x").alias("i")).where(f"i between 0 and {w - 1} and j between 0 and {h - 1}").groupBy("j", "i").agg(F.count("*").alias("n"))


def segments_in_mask(segments: DataFrame, mask: DataFrame) -> DataFrame:
    """Segments of which an end, rounded, is at a set pixel of the mask."""
    set_ = mask.where("v is not null and v != 0").select("j", "i").distinct()
    out, hits = segments, []
    for k in (1, 2):
        own = set_.select(F.col("j").alias(f"mask_j{k}"), F.col("i").alias(f"mask_i{k}"))
        out = out.join(own, (F.floor(F.col(f"x{k}") + 0.5) == F.col(f"mask_i{k}")) & (F.floor(F.col(f"y{k}") + 0.5) == F.col(f"mask_j{k}")), "left")
        hits.append(F.col(f"mask_i{k}").isNotNull())
    return out.where(hits[0] | hits[1]).select(*segments.columns)


def pairs_to_image(pairs: DataFrame) -> DataFrame:
    """Displacements at the rounded first points: the mean of those at one pixel."""
    at = lambda k: F.floor(F.col(k) + 0.5).cast("int")
    return pairs.groupBy(at("y1").alias("j"), at("x1").alias("i")).agg(F.avg(F.col("x2") - F.col("x1")).alias("dx"), F.avg(F.col("y2") - F.col("y1")).alias("dy"))


def image_to_pairs(field: DataFrame) -> DataFrame:
    """Segments from each pixel whose displacement is known."""
    return field.where("dx is not null and dy is not null").select(F.col("i").cast("double").alias("x1"), F.col("j").cast("double").alias("y1"), (F.col("i") + F.col("dx")).alias("x2"), (F.col("j") + F.col("dy")).alias("y2"))


def elevate(pairs: DataFrame, ha: DataFrame, hb: DataFrame) -> DataFrame:
    """Adds z1, z2, the heights at the rounded ends; pairs without both are dropped."""
    out = pairs
    for k, heights in ((1, ha), (2, hb)):
        own = heights.where("v is not null").select(F.col("j").alias(f"j{k}"), F.col("i").alias(f"i{k}"), F.col("v").alias(f"z{k}"))
        out = out.join(own, (F.floor(F.col(f"x{k}") + 0.5) == F.col(f"i{k}")) & (F.floor(F.col(f"y{k}") + 0.5) == F.col(f"j{k}"))).drop(f"i{k}", f"j{k}")
    return out


def match_error(pairs: DataFrame, matrix: list[float]) -> DataFrame:
    """Adds the distance of the second point from the first one's image under a 3x3 homography; null at infinity."""
    a, b, c, d, e, f, g, h, k = map(F.lit, matrix)
    x, y = F.col("x1"), F.col("y1")
    z = g * x + h * y + k
    return pairs.withColumn("error", F.hypot(F.try_divide(a * x + b * y + c, z) - F.col("x2"), F.try_divide(d * x + e * y + f, z) - F.col("y2")))


def match_triplets(ab: DataFrame, ac: DataFrame) -> DataFrame:
    """Keypoints matched both in b and in c: from, tob, toc."""
    return ab.select("from", F.col("to").alias("tob")).join(ac.select("from", F.col("to").alias("toc")), "from")


def split_points(points: DataFrame, side: float, overlap: float) -> DataFrame:
    """Each point at all tiles that contain it, at most four: tiles of ``side`` start every ``side - overlap``; overlap is at most half a side."""
    step = side - overlap

    def tiles(k: str):
        last = F.floor(F.col(k) / step).cast("int")
        return F.explode(F.when(F.col(k) - (last - 1) * step < side, F.array(last - 1, last)).otherwise(F.array(last)))

    return points.withColumn("ti", tiles("x")).withColumn("tj", tiles("y"))


def pair_mask(pairs: DataFrame, t: float, ratio: float) -> DataFrame:
    """Flags pairs whose distance d is below t and below ratio times the second one, d2."""
    return pairs.withColumn("good", F.coalesce((F.col("d") < t) & (F.col("d") < ratio * F.col("d2")), F.lit(False)))


def extreme_vector(px: DataFrame, longest: bool = True) -> DataFrame:
    """The longest (or shortest) vector sample of each cell (j, i), the first image on ties."""
    vectors = px.groupBy("image_id", "j", "i").agg(F.sum(F.col("v") * F.col("v")).alias("s"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("px"))  # as many as channels
    best = vectors.groupBy("j", "i").agg(F.min_by("px", F.struct(-F.col("s") if longest else F.col("s"), F.col("image_id"))).alias("px"))
    return best.select("j", "i", F.explode("px").alias("s")).select("j", "i", "s.c", "s.v")


def geomedian(points: DataFrame, by: str, rounds: int = 10) -> DataFrame:
    """Weiszfeld rounds from the mean: a partial aggregate and a join with one row per group each; samples at the centre weigh nothing."""
    centre = points.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    for _ in range(rounds):
        d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
        w = F.when(d > 0, 1 / d)
        centre = points.join(centre, by).groupBy(by).agg(F.coalesce(F.sum(w * F.col("x")) / F.sum(w), F.first("cx")).alias("cx"), F.coalesce(F.sum(w * F.col("y")) / F.sum(w), F.first("cy")).alias("cy"))
    return centre


def second_best(matches: DataFrame, ratio: float) -> DataFrame:
    """Of ``from, to, d`` the nearest for each ``from`` if it is closer than ``ratio`` times the next."""
    by = Window.partitionBy("from").orderBy("d", "to")
    top = matches.withColumn("k", F.row_number().over(by)).where("k <= 2").groupBy("from").agg(F.min_by("to", "k").alias("to"), F.min("d").alias("d"), F.max(F.when(F.col("k") == 2, F.col("d"))).alias("d2"))
    return top.where(F.col("d2").isNull() | (F.col("d") < ratio * F.col("d2")))


def epipolar_error(pairs: DataFrame, matrix: list[float]) -> DataFrame:
    """Adds ``error``: the distance of x2, y2 from the line that the 3x3 fundamental matrix gives for x1, y1; null where there is none."""
    m = [F.lit(float(k)) for k in matrix]
    a, b, c = (m[3 * k] * F.col("x1") + m[3 * k + 1] * F.col("y1") + m[3 * k + 2] for k in range(3))
    return pairs.withColumn("error", F.try_divide(F.abs(a * F.col("x2") + b * F.col("y2") + c), F.hypot(a, b)))
