"""Neighbourhood operators: structuring elements, morphology, ranks, convolution and box sums.

Morphology, ranks and kernels of any size run on tiles with a halo; stencils of fixed size and sums along an axis are
exploded to offsets or run as sliding windows. Neighbours outside the image, or null, don't count.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators import tiles
from gridweave.operators.pixels import KEYS, filled


def element(name: str) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of cross, square, disk{r}, hrec{w} or vrec{h}."""
    if name == "cross":
        return [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    if name == "square":
        return [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    if name.startswith("disk"):
        r = float(name[4:])
        k = math.floor(r)
        return [(x, y) for x in range(-k, k + 1) for y in range(-k, k + 1) if math.hypot(x, y) < r or x == y == 0]
    n = int(name[4:])
    side = range(-(n // 2), n - n // 2)
    return [(x, 0) for x in side] if name.startswith("hrec") else [(0, y) for y in side]


def gather(px: DataFrame, offsets: list[tuple[int, int]], *aggregates) -> DataFrame:
    """Aggregates of the neighbours ``u`` (at offset dx, dy) of each pixel that exists."""
    moves = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in offsets)))
    sent = px.where("v is not null").select("image_id", "j", "i", "c", "v", moves.alias("o"))
    sent = sent.select("image_id", (F.col("j") - F.col("o.dy")).alias("j"), (F.col("i") - F.col("o.dx")).alias("i"), "c", F.col("v").alias("u"), F.lit(None).cast("double").alias("own"), F.lit(0).alias("here"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"))
    own = px.select("image_id", "j", "i", "c", F.lit(None).cast("double").alias("u"), F.col("v").cast("double").alias("own"), F.lit(1).alias("here"), F.lit(None).cast("int").alias("dx"), F.lit(None).cast("int").alias("dy"))
    return sent.unionByName(own).groupBy(*KEYS).agg(F.max("here").alias("here"), F.max("own").alias("v"), *aggregates).where("here = 1").drop("here")


def erode(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Least known neighbour of each pixel."""
    r = tiles.reach_of(offsets)
    return tiles.on_tiles(px, r, lambda v, known: [tiles.least(v["v"], known["v"], r, offsets)])


def dilate(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Greatest known neighbour of each pixel, by the mirrored element."""
    r, back = tiles.reach_of(offsets), [(-x, -y) for x, y in offsets]
    return tiles.on_tiles(px, r, lambda v, known: [tiles.greatest(v["v"], known["v"], r, back)])


def opening(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(px, offsets), offsets)


def closing(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return erode(dilate(px, offsets), offsets)


def median_filter(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    r = tiles.reach_of(offsets)
    return tiles.on_tiles(px, r, lambda v, known: [tiles.middle(v["v"], known["v"], r, offsets)])


def rank_filter(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Number of known neighbours below the centre."""
    r = tiles.reach_of(offsets)

    def run(v: dict, known: dict) -> list:
        own, x, k = (tiles.moved(v["v"], r, 0, 0), v["v"], known["v"])
        return [(sum(tiles.moved(k, r, *o) & (tiles.moved(x, r, *o) < own) for o in offsets).astype(float), tiles.moved(k, r, 0, 0))]

    return tiles.on_tiles(px, r, run)


def morph(px: DataFrame, offsets: list[tuple[int, int]], op: str) -> DataFrame:
    """gradient, igradient, egradient, laplacian, enhance, blur, iblur, eblur, cblur: one pass yields both extrema (symmetric elements)."""
    r = tiles.reach_of(offsets)
    out = {
        "gradient": lambda v, lo, hi: hi - lo, "igradient": lambda v, lo, hi: v - lo, "egradient": lambda v, lo, hi: hi - v,
        "laplacian": lambda v, lo, hi: (hi + lo - 2 * v) / 2, "enhance": lambda v, lo, hi: v - (hi + lo - 2 * v) / 2, "blur": lambda v, lo, hi: v + (hi + lo - 2 * v) / 2,
        "iblur": lambda v, lo, hi: (v + lo) / 2, "eblur": lambda v, lo, hi: (v + hi) / 2, "cblur": lambda v, lo, hi: v / 2 + lo / 4 + hi / 4,
    }[op]

    def run(v: dict, known: dict) -> list:
        own, there = tiles.moved(v["v"], r, 0, 0), tiles.moved(known["v"], r, 0, 0)
        (lo, any_), (hi, _) = (f(v["v"], known["v"], r, offsets) for f in (tiles.least, tiles.greatest))
        there = any_ if op == "gradient" else there & any_
        with np.errstate(invalid="ignore"):
            return [(out(own, lo, hi), there)]

    return tiles.on_tiles(px, r, run)


def _less(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "u"), KEYS).select(*KEYS, (F.col("v") - F.col("u")).alias("v"))


def tophat(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The image less its opening."""
    return _less(px.select(*KEYS, "v"), opening(px, offsets))


def bottomhat(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The closing less the image."""
    return _less(closing(px, offsets), px.select(*KEYS, "v"))


def oscillation(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The closing less the opening."""
    return _less(closing(px, offsets), opening(px, offsets))


def local_extrema(px: DataFrame) -> DataFrame:
    """Keeps positive strict maxima and negative strict minima among the eight neighbours, else 0."""
    ring = [o for o in element("square") if o != (0, 0)]
    d = gather(px, ring, F.min("u").alias("lo"), F.max("u").alias("hi"))
    keep = ((F.col("v") > 0) & (F.col("v") > F.coalesce("hi", F.lit(float("-inf"))))) | ((F.col("v") < 0) & (F.col("v") < F.coalesce("lo", F.lit(float("inf")))))
    return d.select(*KEYS, F.when(keep, F.col("v")).otherwise(0.0).alias("v"))


def census(px: DataFrame) -> DataFrame:
    """Eight bits, one for each neighbour that is greater than the centre, in raster order."""
    ring = [o for o in sorted(element("square"), key=lambda o: (o[1], o[0])) if o != (0, 0)]
    at = [F.max(F.when((F.col("dx") == x) & (F.col("dy") == y), F.col("u"))).alias(f"n{k}") for k, (x, y) in enumerate(ring)]
    weight = F.lit(0)
    for k in range(len(ring)):
        weight = weight + F.when(F.col(f"n{k}") > F.col("v"), 1 << k).otherwise(0)
    return gather(px, ring, *at).select(*KEYS, weight.cast("double").alias("v"))


def convolve(px: DataFrame, kernel: dict[tuple[int, int], float], normal: str = "known") -> DataFrame:
    """Weighted mean over the known neighbours; ``kernel`` maps (dx, dy) to weights. ``normal`` all: their weighted sum over the sum of all weights."""
    r, total = tiles.reach_of(kernel), sum(kernel.values())

    def run(v: dict, known: dict) -> list:
        k = known["v"]
        top = tiles.weighted(np.where(k, v["v"], 0.0), kernel, r)
        any_ = tiles.over(k, r, list(kernel), np.logical_or)
        if normal == "all":
            return [(top / total, any_)]
        whole = k.all()
        below = total if whole else tiles.weighted(k.astype(float), kernel, r)
        with np.errstate(divide="ignore", invalid="ignore"):
            return [(top / below, any_ & (np.asarray(below) != 0))]

    return tiles.on_tiles(px, r, run)


def box_mean(px: DataFrame, r: int) -> DataFrame:
    """Mean of the known pixels in the square of side 2r+1, by two sliding windows over the whole domain."""
    row = Window.partitionBy("image_id", "j", "c").orderBy("i").rangeBetween(-r, r)
    column = Window.partitionBy("image_id", "i", "c").orderBy("j").rangeBetween(-r, r)
    d = filled(px).withColumn("s", F.sum("v").over(row)).withColumn("n", F.count("v").over(row))
    return d.select(*KEYS, F.try_divide(F.sum("s").over(column), F.sum("n").over(column)).alias("v"), "here").where("here").drop("here")


def integral(px: DataFrame) -> DataFrame:
    """Sum over all known pixels up and to the left, itself included."""
    row = Window.partitionBy("image_id", "j", "c").orderBy("i")
    column = Window.partitionBy("image_id", "i", "c").orderBy("j")
    return filled(px, 0.0).withColumn("v", F.sum("v").over(row)).withColumn("v", F.sum("v").over(column)).where("here").select(*KEYS, "v")


def running_median(series: DataFrame, n: int, by: str, at: str) -> DataFrame:
    """Median of n consecutive places ``at`` centred on each (one more before it where n is even)."""
    frame = Window.partitionBy(by).orderBy(at).rowsBetween(-(n // 2), n - 1 - n // 2)
    ranked = F.sort_array(F.collect_list("v").over(frame))  # n values at most
    size = F.size(ranked)
    low, high = F.get(ranked, F.floor((size - 1) / 2).cast("int")), F.get(ranked, F.floor(size / 2).cast("int"))
    return series.withColumn("m", (low + high) / 2.0)


def smooth_structure_tensor(px: DataFrame, sigma: float) -> DataFrame:
    """Gaussian means, cut at three sigma, of gx*gx, gx*gy and gy*gy, with forward differences that are 0 where the next pixel isn't known."""
    weights = kernel("gauss", sigma)
    r = tiles.reach_of(weights)

    def run(v: dict, known: dict) -> list:
        x, k = v["v"], known["v"]
        ahead = lambda dx, dy: np.where(tiles.moved(k, 1, 0, 0) & tiles.moved(k, 1, dx, dy), tiles.moved(x, 1, dx, dy) - tiles.moved(x, 1, 0, 0), 0.0)
        gx, gy, there = ahead(1, 0), ahead(0, 1), tiles.moved(k, 1, 0, 0)
        below = tiles.weighted(there.astype(float), weights, r)
        any_ = tiles.over(there, r, list(weights), np.logical_or)
        with np.errstate(divide="ignore", invalid="ignore"):
            return [(tiles.weighted(p, weights, r) / below, any_) for p in (gx * gx, gx * gy, gy * gy)]

    return tiles.on_tiles(px, r + 1, run, outputs=("xx", "xy", "yy"))


def structure_tensor(px: DataFrame, r: int) -> DataFrame:
    """Box means of gx*gx, gx*gy and gy*gy, with forward differences that are 0 where the next pixel is missing."""
    row = Window.partitionBy("image_id", "j", "c").orderBy("i")
    column = Window.partitionBy("image_id", "i", "c").orderBy("j")
    ahead = lambda w: F.coalesce(F.first("v").over(w.rangeBetween(1, 1)) - F.col("v"), F.when(F.col("v").isNotNull(), 0.0))
    d = filled(px).withColumn("gx", ahead(row)).withColumn("gy", ahead(column))
    near_i, near_j = row.rangeBetween(-r, r), column.rangeBetween(-r, r)
    names = {"xx": ("gx", "gx"), "xy": ("gx", "gy"), "yy": ("gy", "gy")}
    for k, (a, b) in names.items():
        d = d.withColumn(k, F.sum(F.col(a) * F.col(b)).over(near_i))
    d = d.withColumn("n", F.count("v").over(near_i))
    return d.select(*KEYS, "here", *(F.try_divide(F.sum(k).over(near_j), F.sum("n").over(near_j)).alias(k) for k in names)).where("here").drop("here")


#: Weights of one-dimensional stencils by place.
FORWARD, BACKWARD, CENTRED, SECOND = {1: 1.0, 0: -1.0}, {0: 1.0, -1: -1.0}, {1: 0.5, -1: -0.5}, {1: 1.0, 0: -2.0, -1: 1.0}
SMOOTH = {"sobel": {-1: 0.25, 0: 0.5, 1: 0.25}, "prewitt": {-1: 1 / 3, 0: 1 / 3, 1: 1 / 3}}


def stencil(px: DataFrame, weights: dict[int, float], axis: str) -> DataFrame:
    """Weighted sum of neighbours along one axis; where there is none, or it is null, the pixel itself stands in."""
    other = "j" if axis == "i" else "i"
    line = Window.partitionBy("image_id", other, "c").orderBy(axis)
    at = lambda k: F.col("v") if k == 0 else F.coalesce(F.first("v").over(line.rangeBetween(k, k)), F.col("v"))
    return px.select(*KEYS, sum((at(k) * w for k, w in weights.items()), F.lit(0.0)).alias("v"))


def derivative(px: DataFrame, op: str, scheme: str = "sobel") -> DataFrame:
    """x, y, xx, yy, xy, l (Laplacian), n (gradient norm), g (gradient as channels 0 and 1), H (xx, xy, yy as channels 0 to 2).

    Schemes of first derivatives: forward, backward, centred, sobel, prewitt. xx, yy and l take the plain second difference.
    """
    if op in ("x", "y"):
        axis, across = ("i", "j") if op == "x" else ("j", "i")
        base = stencil(px, {"forward": FORWARD, "backward": BACKWARD}.get(scheme, CENTRED), axis)
        return stencil(base, SMOOTH[scheme], across) if scheme in SMOOTH else base
    if op in ("xx", "yy"):
        return stencil(px, SECOND, "i" if op == "xx" else "j")
    if op == "xy":
        return stencil(stencil(px, CENTRED, "i"), CENTRED, "j")
    two = lambda a, b: a.join(b.withColumnRenamed("v", "u"), KEYS)
    if op == "l":
        return two(derivative(px, "xx"), derivative(px, "yy")).select(*KEYS, (F.col("v") + F.col("u")).alias("v"))
    if op == "n":
        return two(derivative(px, "x", scheme), derivative(px, "y", scheme)).select(*KEYS, F.hypot("v", "u").alias("v"))
    parts = {"g": ("x", "y"), "H": ("xx", "xy", "yy")}[op]
    out = None
    for k, name in enumerate(parts):
        own = derivative(px.where("c = 0"), name, scheme).withColumn("c", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def flow_derivative(field: DataFrame, op: str, scheme: str = "sobel") -> DataFrame:
    """d (divergence) or r (curl) of a field in channels 0 and 1."""
    first, second = (field.where(f"c = {k}").withColumn("c", F.lit(0)) for k in (0, 1))
    a, b = (derivative(first, "x", scheme), derivative(second, "y", scheme)) if op == "d" else (derivative(second, "x", scheme), derivative(first, "y", scheme))
    sign = 1.0 if op == "d" else -1.0
    return a.join(b.withColumnRenamed("v", "u"), KEYS).select(*KEYS, (F.col("v") + sign * F.col("u")).alias("v"))


def _beyond_centre(f):
    """A kernel that has no value at the centre is 1 there."""
    return lambda r, s: f(r, s) if r else 1.0


#: Named kernels as functions of the distance and a parameter.
KERNELS = {
    "gauss": lambda r, s: math.exp(-r * r / (2 * s * s)),
    "laplace": lambda r, s: math.exp(-math.sqrt(2) * r / s),
    "cauchy": lambda r, s: 1 / (1 + (r / s) ** 2),
    "goodcauchy": lambda r, s: (1 + (r / s) ** 2) ** -1.5,
    "logcauchy": _beyond_centre(lambda r, s: 1 / (1 + math.log(r / s) ** 2)),
    "powerlaw": lambda r, s: 1 / (1 + (r / s) ** 4),
    "pareto": _beyond_centre(lambda r, s: r**s),
    "inverse": _beyond_centre(lambda r, s: s / r),
    "inverse_plain": lambda r, s: 1 / r if r else 1 / s,
    "land": _beyond_centre(lambda r, s: (s / r) ** 3),
    "riesz": _beyond_centre(lambda r, s: r ** (s - 2)),
    "inverse_log": _beyond_centre(lambda r, s: 1 / math.log(1.1 + r / s)),
    "log": lambda r, s: -math.log(r) if r else s,
    "r2logr": _beyond_centre(lambda r, s: (r / s) ** 2 * math.log(r / s)),
    "disk": lambda r, s: float(r < s),
}


def kernel(name: str, width: float, radius: int | None = None) -> dict[tuple[int, int], float]:
    """Weights by (dx, dy) of a named kernel, cut at ``radius``: by default where a square or disk ends, else at three widths.

    Kernels with heavy tails (all but gauss, laplace, square and disk) have no natural end; name a radius for them. A
    square has ``width`` pixels a side, rounded down to an odd number.
    """
    if name == "square":
        r = max(0, math.ceil(width / 2) - 1)
        return {(x, y): 1.0 for x in range(-r, r + 1) for y in range(-r, r + 1)}
    r = radius if radius is not None else math.ceil(width if name == "disk" else 3 * width)
    found = {(x, y): KERNELS[name](math.hypot(x, y), width) for x in range(-r, r + 1) for y in range(-r, r + 1)}
    return {k: w for k, w in found.items() if w != 0}


def blur(px: DataFrame, name: str, width: float, boundary: str = "known", complement: bool = False, radius: int | None = None) -> DataFrame:
    """Convolution with a named kernel of sum 1; ``complement`` gives the image less that.

    Boundary: known (weights of the pixels that exist are brought to 1), zero (others count as 0), symmetric or
    periodic (the image goes on beyond its border).
    """
    weights = kernel(name, width, radius)
    if boundary in ("symmetric", "periodic"):
        return _minus(px, convolve(tiles.extended(px, tiles.reach_of(weights), boundary), weights), complement)
    return _minus(px, convolve(px, weights, "all" if boundary == "zero" else "known"), complement)


def _minus(px: DataFrame, out: DataFrame, complement: bool) -> DataFrame:
    if not complement:
        return out
    return px.join(out.withColumnRenamed("v", "u"), KEYS).select(*KEYS, (F.col("v") - F.col("u")).alias("v"))
