"""Slices, searches, joins of parts, drawing, zooms along one axis, and real transforms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators.pixels import KEYS, crop, with_dims


def hslice(px: DataFrame, j: int) -> DataFrame:
    """One raster row of each image; beyond the border the nearest one."""
    d = with_dims(px)
    return d.where(F.col("j") == F.greatest(F.lit(0), F.least(F.lit(j), F.col("h") - 1))).select("image_id", "i", "c", "v")


def tile_inventory(px: DataFrame, tw: int, th: int) -> DataFrame:
    """Tiles across, down and in all of each image."""
    d = px.groupBy("image_id").agg(F.ceil((F.max("i") + 1) / tw).cast("int").alias("across"), F.ceil((F.max("j") + 1) / th).cast("int").alias("down"))
    return d.withColumn("tiles", F.col("across") * F.col("down"))


def crop_around(px: DataFrame, x: int, y: int, r: int) -> DataFrame:
    """The square of side 2r+1 around (x, y), moved to the origin."""
    return crop(px.where(f"i >= {x - r} and j >= {y - r}"), x - r, y - r, x + r + 1, y + r + 1)


def downsa_axis(px: DataFrame, n: int, axis: str) -> DataFrame:
    """Mean of n neighbours along one axis (i or j); an incomplete last block goes."""
    side = {"i": "w", "j": "h"}[axis]
    block = F.floor(F.col(axis) / n).cast("int")
    d = with_dims(px).where((block + 1) * n <= F.col(side)).withColumn(axis, block)
    return d.groupBy(*KEYS).agg(F.avg("v").alias("v"))


def locate(needle: DataFrame, haystack: DataFrame) -> DataFrame:
    """Per haystack image the first place (column by column) where all known pixels of the needle, one image, stand exactly: image_id, i, j.

    Places are proposed by the one pixel of the needle whose value is rarest in the haystack, and each is verified pixel by
    pixel by its position; so a value that fills the haystack is no more than a check. A needle without known pixels is nowhere.
    """
    wanted = needle.where("v is not null").select(F.col("j").alias("nj"), F.col("i").alias("ni"), "c", "v")
    often = haystack.where("v is not null").join(wanted.select("c", "v").distinct(), ["c", "v"], "left_semi").groupBy("c", "v").agg(F.count("*").alias("n"))
    anchor = wanted.join(often, ["c", "v"], "left").select("nj", "ni", "c", "v", F.coalesce("n", F.lit(0)).alias("n"))
    anchor = anchor.groupBy().agg(F.min(F.struct("n", "nj", "ni", "c", "v")).alias("a")).select("a.nj", "a.ni", "a.c", "a.v").where("v is not null")
    places = haystack.join(F.broadcast(anchor), ["c", "v"]).select("image_id", (F.col("j") - F.col("nj")).alias("y"), (F.col("i") - F.col("ni")).alias("x"))  # one row
    size = wanted.agg(F.count("*").alias("all"))
    asked = places.join(wanted, F.lit(True)).select("image_id", "x", "y", "c", "v", (F.col("y") + F.col("nj")).alias("j"), (F.col("x") + F.col("ni")).alias("i"))
    met = asked.join(haystack, ["image_id", "j", "i", "c", "v"], "left_semi").groupBy("image_id", "x", "y").agg(F.count("*").alias("n"))
    return met.join(F.broadcast(size), F.col("n") == F.col("all")).groupBy("image_id").agg(F.min(F.struct("x", "y")).alias("p")).select("image_id", F.col("p.x").alias("i"), F.col("p.y").alias("j"))


def zip_parts(colours: DataFrame, heights: DataFrame) -> DataFrame:
    """Colours and heights of one domain: x, y, z and the channels as columns red, green, blue; pixels without a height are dropped."""
    at = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    rgb = colours.groupBy("image_id", "j", "i").agg(at(0).alias("red"), at(1).alias("green"), at(2).alias("blue"))
    z = heights.where("v is not null and c = 0").select("image_id", "j", "i", F.col("v").alias("z"))
    return rgb.join(z, ["image_id", "j", "i"]).select("image_id", F.col("i").alias("x"), F.col("j").alias("y"), "z", "red", "green", "blue")


def segment_raster(segments: DataFrame, w: int, h: int) -> DataFrame:
    """Number of segments through each pixel: one pixel for each step along the longer axis, ends rounded; outside dropped."""
    x1, y1, x2, y2 = (F.floor(F.col(k) + 0.5) for k in ("x1", "y1", "x2", "y2"))
    d = segments.select(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).withColumn("n", F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))).cast("int"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), "n")))
    along = lambda a, b: F.floor(F.col(a) + F.when(F.col("n") > 0, (F.col(b) - F.col(a)) * F.col("k") / F.col("n")).otherwise(0.0) + 0.5).cast("int")
    return d.select(along("y1", "y2").alias("j"), along("x1", "x2").alias("i")).where(f"i between 0 and {w - 1} and j between 0 and {h - 1}").groupBy("j", "i").agg(F.count("*").alias("n"))


def curve_segments(points: DataFrame, closed: bool = False) -> DataFrame:
    """Segments x1, y1, x2, y2 of curves given by their points id, k (numbered without gaps), x, y; closed ones return to their first point. A curve of any length is joined by point, not gathered."""
    after = points.select("id", (F.col("k") - 1).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    if closed:
        ends = points.groupBy("id").agg(F.max("k").alias("k"), F.min_by(F.struct("x", "y"), "k").alias("p"), F.count("*").alias("n"))
        after = after.unionByName(ends.where("n > 2").select("id", "k", F.col("p.x").alias("x2"), F.col("p.y").alias("y2")))
    return points.join(after, ["id", "k"]).select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def circle_raster(circles: DataFrame, w: int, h: int) -> DataFrame:
    """Number of circles x, y, r through each pixel, and the sum of r; centres and radii are rounded, outside is dropped, negative radii draw nothing.

    One octant is stepped along its long side, and mirrored; a pixel counts once for each circle.
    """
    x, y, r = (F.floor(F.col(k) + 0.5).cast("int").alias(k) for k in ("x", "y", "r"))
    d = circles.select(x, y, r).where("r >= 0").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("r"))))
    d = d.withColumn("b", F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("a") * F.col("a")) + 0.5).cast("int")).where("a <= b")
    a, b = F.col("a"), F.col("b")
    ring = [F.struct((p * s).alias("i"), (q * t).alias("j")) for p, q in ((a, b), (b, a)) for s in (1, -1) for t in (1, -1)]
    d = d.select("x", "y", "r", F.explode(F.array_distinct(F.array(*ring))).alias("o"))
    d = d.select((F.col("y") + F.col("o.j")).alias("j"), (F.col("x") + F.col("o.i")).alias("i"), "r")
    return d.where(f"i between 0 and {w - 1} and j between 0 and {h - 1}").groupBy("j", "i").agg(F.count("*").alias("n"), F.sum("r").alias("radii"))


def spread(px: DataFrame) -> DataFrame:
    """Second-moment spread of a kernel image around its wrapped origin: sqrt(sum v r^2 / sum v) / 1.4."""
    d = with_dims(px)
    wrap = lambda k, n: F.when(F.col(k) * 2 >= F.col(n), F.col(k) - F.col(n)).otherwise(F.col(k))
    x, y = wrap("i", "w"), wrap("j", "h")
    return d.groupBy("image_id").agg((F.sqrt(F.sum(F.col("v") * (x * x + y * y)) / F.sum("v")) / 1.4).alias("spread"))


def _cells(px: DataFrame) -> DataFrame:
    """image_id, c and x0 to x3, the sorted corners, of each 2x2 cell that has all four; a pixel goes to its four cells, so there is one shuffle."""
    at = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (0, 1) for x in (0, 1))))
    d = px.where("v is not null").select("image_id", "j", "i", "c", F.col("v").cast("double").alias("v"), at.alias("o"))
    d = d.groupBy("image_id", "c", (F.col("j") - F.col("o.y")).alias("j"), (F.col("i") - F.col("o.x")).alias("i")).agg(F.sort_array(F.collect_list("v")).alias("q"))  # four at most
    return d.where(F.size("q") == 4).select("image_id", "c", *(F.col("q")[k].alias(f"x{k}") for k in range(4)))


def continuous_histogram(px: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Mass of the surface between pixels by bins, one for each 2x2 cell of corners x0 <= x1 <= x2 <= x3.

    A cell's density rises from x0 to x1, is level to x2 and falls to x3 (a trapezoid), so its distribution function is
    the difference of two pieces of parabola, exact at each end of a bin. A flat cell's mass is in one bin; where x0 = x1 or x2 = x3 the
    density begins or ends at its level. Mass beyond lo and hi isn't counted.
    """
    step = (hi - lo) / bins
    cells = _cells(px).where(f"x3 >= {lo} and x0 < {hi}")
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / step))).cast("int")
    d = cells.withColumn("bin", F.explode(F.sequence(at("x0"), at("x3"))))
    spread = F.col("x2") + F.col("x3") - F.col("x0") - F.col("x1")

    def ramp(x: Column, a: str, b: str) -> Column:
        a, b = F.col(a), F.col(b)
        return F.when(x <= a, 0.0).when(x >= b, 2 * x - a - b).otherwise((x - a) * (x - a) / (b - a))

    upto = lambda x: (ramp(x, "x0", "x1") - ramp(x, "x2", "x3")) / spread
    flat = F.when((F.col("x0") >= lo) & (F.col("x0") < hi), 1.0).otherwise(0.0)
    part = F.when(F.col("x0") == F.col("x3"), flat).otherwise(upto(lo + (F.col("bin") + 1) * step) - upto(lo + F.col("bin") * step))
    return d.groupBy("image_id", "bin").agg(F.sum(part).alias("mass")).where("mass > 1e-12")


def density_by_jumps(px: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Density of the surface between pixels at ``bins`` places: image_id, bin, value, density.

    The second difference of the density: each 2x2 cell adds a jump at the place of each of its sorted corners, and two
    running sums over the places give the density. Cells that are degenerate leave no trace: a corner beyond lo and hi, two
    corners alike or at one place. Images of no other cells have density 0 everywhere.
    """
    place = lambda k: F.rint((bins - 1) * (F.col(f"x{k}") - lo) / (hi - lo)).cast("int").alias(f"p{k}")
    d = _cells(px).where(f"x0 >= {lo} and x3 <= {hi} and x0 < x1 and x1 < x2 and x2 < x3").select("image_id", *(place(k) for k in range(4))).where("p0 < p1 and p1 < p2 and p2 < p3")
    level = 2.0 / (F.col("p2") + F.col("p3") - F.col("p0") - F.col("p1"))
    up, down = level / (F.col("p1") - F.col("p0")), level / (F.col("p3") - F.col("p2"))
    jumps = F.explode(F.array(*(F.struct(F.col(f"p{k}").alias("bin"), v.alias("jump")) for k, v in enumerate((up, -up, -down, down)))))
    sums = d.select("image_id", jumps.alias("e")).groupBy("image_id", F.col("e.bin").alias("bin")).agg(F.sum("e.jump").alias("jump"))
    grid = px.select("image_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    by = Window.partitionBy("image_id").orderBy("bin")  # an image has as many rows here as there are bins
    out = grid.join(sums, ["image_id", "bin"], "left").withColumn("slope", F.sum(F.coalesce("jump", F.lit(0.0))).over(by))
    return out.select("image_id", "bin", (lo + F.col("bin") * ((hi - lo) / bins)).alias("value"), F.sum("slope").over(by).alias("density"))


def fit_curves(hist: DataFrame) -> DataFrame:
    """Mass, mean and sigma of each histogram ``image_id, v, n``, and the Gauss and Laplace densities of these at each value."""
    m = hist.groupBy("image_id").agg(F.sum("n").alias("mass"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n")).alias("square"))
    m = m.select("image_id", "mass", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("sigma"))
    x, s = F.col("v") - F.col("mean"), F.col("sigma")
    gauss = F.when(s > 0, F.exp(-x * x / (2 * s * s)) / (s * math.sqrt(2 * math.pi)))
    laplace = F.when(s > 0, F.exp(-F.abs(x) * math.sqrt(2) / s) / (s * math.sqrt(2)))
    return hist.join(m, "image_id").select("image_id", "v", "n", "mass", "mean", "sigma", gauss.alias("gauss"), laplace.alias("laplace"))


def line_profile(px: DataFrame, angle: float, n: int) -> DataFrame:
    """Bilinear samples at n places along the line through the centre of each image, as long as its smaller side: image_id, k, v."""
    d = with_dims(px)
    dims = d.select("image_id", "c", "w", "h").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = (F.col("k") / float(n - 1) - 0.5) * (F.least("w", "h") - 1)
    dims = dims.withColumn("x", (F.col("w") - 1) / 2.0 + t * math.cos(angle)).withColumn("y", (F.col("h") - 1) / 2.0 + t * math.sin(angle))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    near = dims.select("image_id", "c", "k", "x", "y", corner.alias("o"))
    part = lambda z, s: F.when(s == 1, F.col(z) - F.floor(z)).otherwise(1 - (F.col(z) - F.floor(z)))
    near = near.withColumn("wt", part("x", F.col("o.a")) * part("y", F.col("o.b"))).where("wt > 1e-12")
    near = near.select("image_id", "c", "k", "wt", (F.floor("y") + F.col("o.b")).cast("int").alias("j"), (F.floor("x") + F.col("o.a")).cast("int").alias("i"))
    return near.join(px.where("v is not null").select(*KEYS, "v"), KEYS).groupBy("image_id", "c", "k").agg((F.sum(F.col("wt") * F.col("v")) / F.sum("wt")).alias("v"))


def disparity_to_pairs(px: DataFrame, ha: list[float], hb: list[float]) -> DataFrame:
    """Pixels (i, j) and (i + v, j) moved by two homographies: x1, y1, x2, y2."""
    def move(x, y, m, a, b):
        z = m[6] * x + m[7] * y + m[8]
        return F.try_divide(m[0] * x + m[1] * y + m[2], z).alias(a), F.try_divide(m[3] * x + m[4] * y + m[5], z).alias(b)

    ma, mb = ([F.lit(float(k)) for k in m] for m in (ha, hb))
    d = px.where("v is not null and c = 0")
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    return d.select("image_id", *move(i, j, ma, "x1", "y1"), *move(i + F.col("v"), j, mb, "x2", "y2"))


def to_utm(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds zone, east and north: transverse Mercator of the zone by the third-order Krueger series on WGS84 (northern origin)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    d = points.withColumn("zone", (F.pmod(F.floor((F.col(lon) + 180) / 6), F.lit(60)) + 1).cast("int"))
    p, q = F.radians(lat), F.radians(F.col(lon) - (F.col("zone") * 6 - 183))
    t = F.sinh(F.atanh(F.sin(p)) - k * F.atanh(k * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(q)), F.atanh(F.sin(q) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * (m + 1) * xi) * F.sinh(2 * (m + 1) * eta) for m, a in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * (m + 1) * xi) * F.cosh(2 * (m + 1) * eta) for m, a in enumerate(alpha)), F.lit(0.0))
    return d.withColumn("east", 500000 + 0.9996 * radius * east).withColumn("north", 0.9996 * radius * north)


def _real_lines(px: DataFrame, fixed: str, run: str, kind: str) -> DataFrame:
    """Real transform of each line: a group is one row or column of one channel."""
    own = px.schema["image_id"].dataType.simpleString()

    def turn(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["w" if run == "i" else "h"].iloc[0])
        x = np.zeros(n)
        x[rows[run]] = rows["v"].to_numpy()
        if kind == "dct":
            z = np.fft.fft(np.concatenate([x, x[::-1]]))[:n]
            x = (z * np.exp(-1j * np.pi * np.arange(n) / (2 * n))).real
        else:
            z = np.fft.fft(x)
            x = z.real - z.imag
        same = {k: rows[k].iloc[0] for k in ("image_id", fixed, "c", "w", "h")}
        return pd.DataFrame({**same, run: np.arange(n), "v": x})[list(rows.columns)]

    return px.select("image_id", "j", "i", "c", "w", "h", "v").groupBy("image_id", "c", fixed).applyInPandas(turn, f"image_id {own}, j int, i int, c int, w int, h int, v double")


def real_transform(px: DataFrame, kind: str) -> DataFrame:
    """``dct``: sum of 2 v cos(pi k (2n+1) / 2N) along rows, then columns; ``dht``: the Hartley sum of v (cos + sin) of each. Missing pixels are 0."""
    d = with_dims(px.select(*KEYS, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")))
    return _real_lines(_real_lines(d, "j", "i", kind), "i", "j", kind).select(*KEYS, "v")


def nonmaximum_along(px: DataFrame, field: DataFrame) -> DataFrame:
    """Pixels that exceed both neighbours along the field ``gx, gy`` (rounded unit steps); all others become 0. Without a direction none is kept."""
    n = F.hypot("gx", "gy")
    d = px.select(*KEYS, "v").join(field.select("image_id", "j", "i", "gx", "gy"), ["image_id", "j", "i"], "left")
    d = d.withColumn("sx", F.rint(F.try_divide("gx", n)).cast("int")).withColumn("sy", F.rint(F.try_divide("gy", n)).cast("int"))
    for sign, name in ((1, "ahead"), (-1, "behind")):
        other = px.select("image_id", F.col("j").alias("oj"), F.col("i").alias("oi"), F.col("c").alias("oc"), F.col("v").alias(name), F.col("image_id").alias("oid")).drop("image_id")
        d = d.join(other, (F.col("image_id") == F.col("oid")) & (F.col("c") == F.col("oc")) & (F.col("oj") == F.col("j") + sign * F.col("sy")) & (F.col("oi") == F.col("i") + sign * F.col("sx")), "left").drop("oid", "oj", "oi", "oc")
    low = F.lit(float("-inf"))
    keep = F.col("sx").isNotNull() & (F.col("v") > F.coalesce("ahead", low)) & (F.col("v") > F.coalesce("behind", low))
    return d.select(*KEYS, F.when(keep, F.col("v")).otherwise(0.0).alias("v"))


def corner_measure(px: DataFrame, kappa: float = 0.04) -> DataFrame:
    """Laplacian less kappa times the centred gradient, summed over channels; 0 outside the image."""
    row, column = Window.partitionBy("image_id", "j", "c").orderBy("i"), Window.partitionBy("image_id", "i", "c").orderBy("j")
    at = lambda w, k: F.coalesce(F.first("v").over(w.rangeBetween(k, k)), F.lit(0.0))
    d = px.select(*KEYS, "v", at(row, 1).alias("r"), at(row, -1).alias("l"), at(column, 1).alias("b"), at(column, -1).alias("a"))
    value = 4 * F.col("v") - F.col("r") - F.col("l") - F.col("b") - F.col("a") - kappa * F.hypot(F.col("r") - F.col("l"), F.col("b") - F.col("a"))
    return d.groupBy("image_id", "j", "i").agg(F.sum(value).alias("v")).select("image_id", "j", "i", F.lit(0).alias("c"), "v")
