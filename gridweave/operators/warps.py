"""Resampling and re-laying of pixel tables: warps, zooms, paddings and tilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators.pixels import KEYS, with_dims
from gridweave.storage import discard, materialise


def _span(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def sample(px: DataFrame, targets: DataFrame, order: int = 1) -> DataFrame:
    """``targets`` (image_id, j, i, c and source place x, y) take the nearest pixel (order 0) or the bilinear mix (order 1); null where a pixel that counts is missing.

    An equi join on the source cell; a target asks for 1 or at most 4 pixels.
    """
    source = px.select("image_id", "c", F.col("j").alias("sj"), F.col("i").alias("si"), "v")
    if order == 0:
        want = targets.select(*KEYS, F.floor(F.col("y") + 0.5).cast("int").alias("sj"), F.floor(F.col("x") + 0.5).cast("int").alias("si"))
        return want.join(source, ["image_id", "c", "sj", "si"], "left").select(*KEYS, "v")
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corners = F.array(*(F.struct((F.floor("y") + b).cast("int").alias("sj"), (F.floor("x") + a).cast("int").alias("si"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for b in (0, 1) for a in (0, 1)))
    want = targets.where("x is not null and y is not null").select(*KEYS, F.explode(F.filter(corners, lambda k: k["w"] > 0)).alias("k")).select(*KEYS, "k.*")
    found = want.join(source, ["image_id", "c", "sj", "si"], "left").groupBy(*KEYS).agg(F.when(F.count("v") == F.count("*"), F.sum(F.col("w") * F.col("v"))).alias("v"))
    return targets.select(*KEYS).join(found, KEYS, "left")


def homwarp(px: DataFrame, matrix: list[float], w: int, h: int, order: int = 1) -> DataFrame:
    """A w x h image whose pixel (i, j) is taken at the place that the 3x3 matrix sends it to; null outside."""
    a, b, c, d, e, f, g, k, m = map(F.lit, matrix)
    grid = px.select("image_id", "c").distinct().withColumn("j", _span(h)).withColumn("i", _span(w))
    z = g * F.col("i") + k * F.col("j") + m
    return sample(px, grid.withColumns({"x": F.try_divide(a * F.col("i") + b * F.col("j") + c, z), "y": F.try_divide(d * F.col("i") + e * F.col("j") + f, z)}), order)


def warp(px: DataFrame, field: DataFrame, order: int = 1) -> DataFrame:
    """Pull back by a displacement field ``image_id, j, i, dx, dy``; every channel moves alike."""
    channels = px.select("image_id", "c").distinct()
    return sample(px, field.join(channels, "image_id").withColumns({"x": F.col("i") + F.col("dx"), "y": F.col("j") + F.col("dy")}), order)


def _field_at(field: DataFrame, targets: DataFrame) -> DataFrame:
    """dx and dy of ``field`` at the places x, y of ``targets`` (image_id, j, i), bilinear, beyond the border as on it: null where a corner that counts is missing."""
    size = field.groupBy("image_id").agg(F.max("i").alias("w"), F.max("j").alias("h"))
    t = targets.join(size, "image_id").withColumns({"x": F.greatest(F.lit(0.0), F.least(F.col("w").cast("double"), "x")), "y": F.greatest(F.lit(0.0), F.least(F.col("h").cast("double"), "y"))})
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corners = F.array(*(F.struct((F.floor("y") + b).cast("int").alias("sj"), (F.floor("x") + a).cast("int").alias("si"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("wt")) for b in (0, 1) for a in (0, 1)))
    asked = t.select("image_id", "j", "i", F.explode(F.filter(corners, lambda k: k["wt"] > 0)).alias("k")).select("image_id", "j", "i", "k.*")
    source = field.select("image_id", F.col("j").alias("sj"), F.col("i").alias("si"), "dx", "dy")
    whole = (F.count("dx") == F.count("*")) & (F.count("dy") == F.count("*"))
    return asked.join(source, ["image_id", "sj", "si"], "left").groupBy("image_id", "j", "i").agg(*(F.when(whole, F.sum(F.col("wt") * F.col(k))).alias(k) for k in ("dx", "dy")))


def invert_field(field: DataFrame, tolerance: float = 1e-3, rounds: int = 100) -> DataFrame:
    """The field that undoes ``field`` (image_id, j, i, dx, dy): v(p) = -u(p + v(p)), by fixed-point rounds from -u.

    It ends when no vector moved by more than ``tolerance``, or after ``rounds``; where u isn't known v is null. Each round is one
    join with the four corners of each place, and its result is written, so lineage stays short.
    """
    own = materialise(field.select("image_id", "j", "i", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")))
    now = own.select("image_id", "j", "i", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
    for k in range(rounds):
        known = now.where("dx is not null and dy is not null")
        found = _field_at(own, known.select("image_id", "j", "i", (F.col("i") + F.col("dx")).alias("x"), (F.col("j") + F.col("dy")).alias("y")))
        found = found.select("image_id", "j", "i", (-F.col("dx")).alias("nx"), (-F.col("dy")).alias("ny"))
        moved = F.hypot(F.col("nx") - F.col("dx"), F.col("ny") - F.col("dy"))
        after = materialise(now.join(found, ["image_id", "j", "i"], "left").select("image_id", "j", "i", F.col("nx").alias("dx"), F.col("ny").alias("dy"), moved.alias("moved")))
        if k:
            discard(now)
        now = after
        if (now.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return now.select("image_id", "j", "i", "dx", "dy")


def upsa(px: DataFrame, n: int) -> DataFrame:
    """Bilinear zoom by n between pixel centres: n*w-n by n*h-n. Four corners come from two windows, targets from each cell."""
    row, column = Window.partitionBy("image_id", "j", "c").orderBy("i"), Window.partitionBy("image_id", "i", "c").orderBy("j")
    d = px.withColumn("r", F.lead("v").over(row)).withColumn("ri", F.lead("i").over(row))
    d = d.withColumn("b", F.lead("v").over(column)).withColumn("br", F.lead("r").over(column)).withColumn("bj", F.lead("j").over(column)).withColumn("bri", F.lead("ri").over(column))
    d = d.where("ri = i + 1 and bj = j + 1 and bri = i + 1").withColumn("s", _span(n)).withColumn("t", _span(n))
    x, y = F.col("t") / n, F.col("s") / n
    v = (1 - y) * ((1 - x) * F.col("v") + x * F.col("r")) + y * ((1 - x) * F.col("b") + x * F.col("br"))
    return d.select("image_id", (F.col("j") * n + F.col("s")).alias("j"), (F.col("i") * n + F.col("t")).alias("i"), "c", v.alias("v"))


def tbcat(a: DataFrame, b: DataFrame, image_id: str | None = "tbcat") -> DataFrame:
    """b below a; with ``image_id`` None images of one id by themselves, those that only one side has as they are."""
    if image_id is None:
        height = a.groupBy("image_id").agg((F.max("j") + 1).alias("h"))
        below = b.join(height, "image_id", "left").select("image_id", (F.col("j") + F.coalesce("h", F.lit(0))).alias("j"), "i", "c", "v")
        return a.select(*KEYS, "v").unionByName(below)
    height = a.agg(F.coalesce(F.max("j") + 1, F.lit(0)).alias("h"))  # one row
    below = b.join(height, F.lit(True)).select((F.col("j") + F.col("h")).alias("j"), "i", "c", "v")
    return a.select("j", "i", "c", "v").unionByName(below).select(F.lit(image_id).alias("image_id"), "j", "i", "c", "v")


def zeropad(px: DataFrame, w: int, h: int) -> DataFrame:
    """A w x h image: what is inside stays, the rest is 0."""
    grid = px.select("image_id", "c").distinct().withColumn("j", _span(h)).withColumn("i", _span(w))
    return grid.join(px.select(*KEYS, "v", F.lit(True).alias("here")), KEYS, "left").select(*KEYS, F.when(F.col("here"), F.col("v")).otherwise(0.0).alias("v"))


def _tiled(px: DataFrame, mirror: bool) -> DataFrame:
    d = with_dims(px).withColumn("s", _span(2)).withColumn("t", _span(2))
    at = lambda k, n, side: F.when(F.col(side) == 0, F.col(k)).otherwise(2 * F.col(n) - 1 - F.col(k) if mirror else F.col(n) + F.col(k))
    return d.select("image_id", at("j", "h", "s").alias("j"), at("i", "w", "t").alias("i"), "c", "v")


def periodize(px: DataFrame) -> DataFrame:
    """2 x 2 mirrored copies, so that opposite borders meet."""
    return _tiled(px, True)


def replicate(px: DataFrame) -> DataFrame:
    """2 x 2 plain copies."""
    return _tiled(px, False)


def redim(px: DataFrame, w: int) -> DataFrame:
    """The same pixels in raster order, laid out in rows of w."""
    place = F.col("j").cast("bigint") * F.col("w") + F.col("i")
    return with_dims(px).select("image_id", F.floor(place / w).cast("int").alias("j"), F.pmod(place, F.lit(w)).cast("int").alias("i"), "c", "v")


def imhalve(px: DataFrame) -> DataFrame:
    """The first quarter."""
    return with_dims(px).where((F.col("i") < F.floor(F.col("w") / 2)) & (F.col("j") < F.floor(F.col("h") / 2))).select(*KEYS, "v")


def unalpha(px: DataFrame) -> DataFrame:
    """Without the last channel where there are two or four."""
    depth = px.groupBy("image_id").agg((F.max("c") + 1).alias("depth"))
    return px.join(depth, "image_id").where("depth not in (2, 4) or c < depth - 1").select(*KEYS, "v")
