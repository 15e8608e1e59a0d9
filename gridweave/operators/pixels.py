"""Pixel tables ``image_id, j, i, c, v``: expressions, masks, geometry and sets. A missing pixel is a null or no row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["image_id", "j", "i", "c"]
CELL = ["image_id", "c"]


def pixel_expr(images: dict[str, DataFrame], fn: Callable[..., Column], image_id: str | None = "expr") -> DataFrame:
    """One image from an expression over several of one domain: ``fn`` gets a column for each name. Joined on (j, i, c).

    With ``image_id`` None each table may hold many images, and those of one id are put together.
    """
    out, by = None, ["j", "i", "c"] if image_id else KEYS
    for name, px in images.items():
        own = px.select(*by, F.col("v").alias(name))
        out = own if out is None else out.join(own, by)
    name = F.lit(image_id).alias("image_id") if image_id else "image_id"
    return out.select(name, "j", "i", "c", fn(**{n: F.col(n) for n in images}).alias("v"))


def successors(px: DataFrame) -> DataFrame:
    """Each image but the first under the id of the one before it, in the order of ids. The ids, a row for each image, are numbered in one task."""
    ids = px.select("image_id").distinct()
    before = ids.withColumn("before_", F.lag("image_id").over(Window.orderBy("image_id"))).where("before_ is not null")
    return px.join(before, "image_id").withColumn("image_id", F.col("before_")).select(*px.columns)


def affine(px: DataFrame, a: float, b: float) -> DataFrame:
    return px.withColumn("v", F.col("v") * a + b)


def affine2(p: DataFrame, q: DataFrame, a: float, b: float, c: float = 0.0) -> DataFrame:
    """a*p + b*q + c on the common domain of images of one id."""
    return p.join(q.select(*KEYS, F.col("v").alias("w")), KEYS).select(*KEYS, (F.col("v") * a + F.col("w") * b + c).alias("v"))


def norm(px: DataFrame) -> DataFrame:
    """Euclidean norm of each vector pixel."""
    return px.groupBy("image_id", "j", "i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v")).select("image_id", "j", "i", F.lit(0).alias("c"), "v")


def with_dims(px: DataFrame) -> DataFrame:
    """Adds w and h of the image (one past the greatest column and row), from one small aggregate."""
    dims = px.groupBy("image_id").agg((F.max("i") + 1).alias("w"), (F.max("j") + 1).alias("h"))
    return px.join(dims, "image_id")


def dims(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("i") + 1).alias("w"), (F.max("j") + 1).alias("h"), (F.max("c") + 1).alias("pd"), F.count("v").alias("n"))


def with_coords(px: DataFrame) -> DataFrame:
    """Adds x, y in [-1, 1), r and t (polar) and the linear place."""
    d = with_dims(px).withColumn("x", 2.0 * F.col("i") / F.col("w") - 1).withColumn("y", 2.0 * F.col("j") / F.col("h") - 1)
    return d.withColumn("r", F.hypot("x", "y")).withColumn("t", F.atan2("y", "x")).withColumn("place", F.col("j").cast("bigint") * F.col("w") + F.col("i"))


def with_stats(px: DataFrame) -> DataFrame:
    """Adds lo, hi, mean, total and sigma of the image to each pixel."""
    stats = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.stddev_pop("v").alias("sigma"))
    return px.join(stats, "image_id")


def filled(px: DataFrame, value: float | None = None) -> DataFrame:
    """All pixels of the domain of each image and channel: those without a row get ``value``, and ``here`` tells which had one."""
    size = px.groupBy("image_id").agg(F.max("i").alias("w"), F.max("j").alias("h"))
    grid = px.select("image_id", "c").distinct().join(size, "image_id").withColumn("j", F.explode(F.sequence(F.lit(0), "h"))).withColumn("i", F.explode(F.sequence(F.lit(0), "w")))
    own = px.select(*KEYS, F.col("v").cast("double").alias("v"), F.lit(True).alias("here"))
    v = F.col("v") if value is None else F.coalesce("v", F.lit(float(value)))
    return grid.select(*KEYS).join(own, KEYS, "left").select(*KEYS, v.alias("v"), F.coalesce("here", F.lit(False)).alias("here"))


def shift(px: DataFrame, dx: int, dy: int, boundary: str = "nearest") -> DataFrame:
    """Pixel (i, j) takes the value at (i+dx, j+dy); outside by nearest, zero, periodic, symmetric or null."""
    full = with_dims(px)

    def wrap(k: Column, n: Column) -> Column:
        if boundary == "nearest":
            return F.greatest(F.lit(0), F.least(k, n - 1))
        if boundary == "periodic":
            return F.pmod(k, n)
        if boundary == "symmetric":
            m = F.pmod(k, 2 * n)
            return F.when(m < n, m).otherwise(2 * n - 1 - m)
        return k

    want = full.select(*KEYS, wrap(F.col("i") + dx, F.col("w")).alias("si"), wrap(F.col("j") + dy, F.col("h")).alias("sj"))
    found = want.join(px.select("image_id", F.col("j").alias("sj"), F.col("i").alias("si"), "c", "v"), ["image_id", "sj", "si", "c"], "left")
    return found.select(*KEYS, F.coalesce("v", F.lit(0.0)).alias("v") if boundary == "zero" else F.col("v"))


def where_mask(px: DataFrame, mask: DataFrame, keep: bool = True) -> DataFrame:
    """Pixels where the mask (any channel nonzero) is set, or isn't."""
    set_ = mask.where("v is not null and v != 0").select("image_id", "j", "i").distinct()
    return px.join(set_, ["image_id", "j", "i"], "left_semi" if keep else "left_anti")


def good(px: DataFrame, criterion: str = "finite") -> DataFrame:
    tests = {"numeric": ~F.isnan("v"), "finite": ~F.isnan("v") & (F.abs("v") < float("inf")), "nonzero": F.col("v") != 0, "nonnegative": F.col("v") >= 0, "positive": F.col("v") > 0}
    return px.where(F.col("v").isNotNull() & tests[criterion])


def component(px: DataFrame, c: int) -> DataFrame:
    return px.where(F.col("c") == c).withColumn("c", F.lit(0))


def get_bands(px: DataFrame) -> DataFrame:
    """Each channel becomes an image ``image_id/c``."""
    return px.select(F.concat_ws("/", F.col("image_id").cast("string"), F.col("c").cast("string")).alias("image_id"), "j", "i", F.lit(0).alias("c"), "v")


def band_slice(guide: DataFrame, px: DataFrame) -> DataFrame:
    """At each pixel the channel that ``guide`` names there; null out of range."""
    want = guide.select("image_id", "j", "i", F.col("v").cast("int").alias("c"))
    return want.join(px.select(*KEYS, "v"), KEYS, "left").select("image_id", "j", "i", F.lit(0).alias("c"), "v")


def columnize(px: DataFrame, channels: list[int], keep_zero: bool = False) -> DataFrame:
    """A row for each pixel with its channels as columns; missing never, all-zero ones only on request."""
    names = [f"v{c}" for c in channels]
    out = px.where("v is not null").groupBy("image_id", "j", "i").agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(n) for c, n in zip(channels, names)))
    return out if keep_zero else out.where(" or ".join(f"{n} != 0" for n in names))


def lookup(px: DataFrame, queries: DataFrame, outside: str = "drop") -> DataFrame:
    """Values at the positions ``image_id, j, i``; outside dropped or null. Spark broadcasts the smaller side if it is small."""
    return queries.join(px.select(*KEYS, "v"), ["image_id", "j", "i"], "inner" if outside == "drop" else "left")


def crop(px: DataFrame, x0: int, y0: int, xf: int, yf: int) -> DataFrame:
    """Columns x0 to xf-1 and rows y0 to yf-1, moved to the origin; a far corner of 0 or less counts from the end."""
    out = with_dims(px) if xf <= 0 or yf <= 0 else px
    far = lambda f, n: F.lit(f) if f > 0 else F.col(n) + f
    out = out.where((F.col("i") >= x0) & (F.col("i") < far(xf, "w")) & (F.col("j") >= y0) & (F.col("j") < far(yf, "h")))
    return out.select("image_id", (F.col("j") - y0).alias("j"), (F.col("i") - x0).alias("i"), "c", "v")


def autotrim(px: DataFrame) -> DataFrame:
    """The bounding box of what isn't missing, moved to the origin."""
    box = px.where("v is not null").groupBy("image_id").agg(F.min("j").alias("j0"), F.max("j").alias("j1"), F.min("i").alias("i0"), F.max("i").alias("i1"))
    return px.join(box, "image_id").where("j between j0 and j1 and i between i0 and i1").select("image_id", (F.col("j") - F.col("j0")).alias("j"), (F.col("i") - F.col("i0")).alias("i"), "c", "v")


def flip(px: DataFrame, kind: str) -> DataFrame:
    """leftright, topdown, transpose, posetrans, r90, r180, r270 or identity."""
    d = with_dims(px)
    i, j, w, h = (F.col(k) for k in ("i", "j", "w", "h"))
    to = {"identity": (j, i), "leftright": (j, w - 1 - i), "topdown": (h - 1 - j, i), "transpose": (i, j), "r90": (w - 1 - i, j), "r180": (h - 1 - j, w - 1 - i), "r270": (i, h - 1 - j), "posetrans": (w - 1 - i, h - 1 - j)}[kind]
    return d.select("image_id", to[0].alias("j"), to[1].alias("i"), "c", "v")


def lrcat(a: DataFrame, b: DataFrame, image_id: str = "lrcat") -> DataFrame:
    """b to the right of a; only the width of a is aggregated."""
    width = a.agg((F.max("i") + 1).alias("w"))
    right = b.join(width, how="cross").select("j", (F.col("i") + F.coalesce("w", F.lit(0))).alias("i"), "c", "v")
    return a.select("j", "i", "c", "v").unionByName(right).select(F.lit(image_id).alias("image_id"), "j", "i", "c", "v")


def ntiply(px: DataFrame, n: int) -> DataFrame:
    """Zoom in by replication."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    out = px.withColumn("dj", F.explode(steps)).withColumn("di", F.explode(steps))
    return out.select("image_id", (F.col("j") * n + F.col("dj")).alias("j"), (F.col("i") * n + F.col("di")).alias("i"), "c", "v")


def log_average() -> Column:
    """Exponential of the mean logarithm: 0 if a sample is 0, null if one is negative."""
    return F.when(F.min("v") == 0, 0.0).when(F.min("v") > 0, F.exp(F.avg(F.ln("v"))))


def downsa(px: DataFrame, n: int, rule: str = "v") -> DataFrame:
    """Combine n x n blocks; incomplete ones at the far borders go. Rules: i min, a max, v average, s root of summed squared deviations, n count, e median, l log average."""
    d = with_dims(px).where((F.floor(F.col("i") / n) + 1) * n <= F.col("w")).where((F.floor(F.col("j") / n) + 1) * n <= F.col("h"))
    agg = {"i": F.min("v"), "a": F.max("v"), "v": F.avg("v"), "s": F.sqrt(F.var_pop("v") * F.count("v")), "n": F.count("v").cast("double"), "e": F.median("v"), "l": log_average()}[rule]
    return d.groupBy("image_id", F.floor(F.col("j") / n).cast("int").alias("j"), F.floor(F.col("i") / n).cast("int").alias("i"), "c").agg(agg.alias("v")).select(*KEYS, "v")


def pyramid(px: DataFrame, octaves: int) -> DataFrame:
    """Octave 0 is the image; each next averages 2x2 blocks, with sizes rounded up. One aggregate for each octave."""
    out, level = px.select(*KEYS, "v").withColumn("octave", F.lit(0)), px.select(*KEYS, "v")
    for k in range(1, octaves):
        level = level.groupBy("image_id", F.floor(F.col("j") / 2).cast("int").alias("j"), F.floor(F.col("i") / 2).cast("int").alias("i"), "c").agg(F.avg("v").alias("v"))
        out = out.unionByName(level.withColumn("octave", F.lit(k)))
    return out


def fftshift(px: DataFrame) -> DataFrame:
    d = with_dims(px)
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    return d.select("image_id", F.pmod(F.col("j") + half("h"), F.col("h")).alias("j"), F.pmod(F.col("i") + half("w"), F.col("w")).alias("i"), "c", "v")


def deinterlace(px: DataFrame) -> DataFrame:
    """Even rows above odd ones."""
    d = with_dims(px)
    return d.select("image_id", F.when(F.col("j") % 2 == 0, F.col("j") / 2).otherwise(F.ceil(F.col("h") / 2) + F.floor(F.col("j") / 2)).cast("int").alias("j"), "i", "c", "v")


def bayer_parts(px: DataFrame) -> DataFrame:
    """The four phases of a 2x2 mosaic as channels."""
    return px.select("image_id", F.floor(F.col("j") / 2).cast("int").alias("j"), F.floor(F.col("i") / 2).cast("int").alias("i"), (F.col("j") % 2 * 2 + F.col("i") % 2).alias("c"), "v")


def tileize(px: DataFrame, tw: int, th: int) -> DataFrame:
    """Tiles as arrays of samples; a tile is bounded by its size."""
    cell = F.struct(F.pmod("j", F.lit(th)).alias("j"), F.pmod("i", F.lit(tw)).alias("i"), "c", "v")
    return px.groupBy("image_id", F.floor(F.col("j") / th).cast("int").alias("tj"), F.floor(F.col("i") / tw).cast("int").alias("ti")).agg(F.sort_array(F.collect_list(cell)).alias("samples"))


def untile(tiles: DataFrame, tw: int, th: int) -> DataFrame:
    s = tiles.select("image_id", "tj", "ti", F.explode("samples").alias("s"))
    return s.select("image_id", (F.col("tj") * th + F.col("s.j")).alias("j"), (F.col("ti") * tw + F.col("s.i")).alias("i"), F.col("s.c").alias("c"), F.col("s.v").alias("v"))


def fill_rows(px: DataFrame, w: int) -> DataFrame:
    """Null or absent pixels of each row of width ``w``: linear between the known ends, constant beyond them.

    A row of an image is one window group, bounded by its width.
    """
    rows = px.select("image_id", "j", "c").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    d = rows.join(px.select(*KEYS, "v"), KEYS, "left")
    known = F.when(F.col("v").isNotNull(), F.struct("i", "v"))
    by = Window.partitionBy("image_id", "j", "c").orderBy("i")
    d = d.withColumn("a", F.last(known, True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(known, True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    inner = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("i") - F.col("a.i")) / (F.col("b.i") - F.col("a.i"))
    return d.select(*KEYS, F.coalesce("v", inner, "a.v", "b.v").alias("v"))


def fill_up(px: DataFrame, h: int) -> DataFrame:
    """A missing pixel takes the nearest known one below it in its column."""
    columns = px.select("image_id", "i", "c").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    by = Window.partitionBy("image_id", "i", "c").orderBy("j").rowsBetween(0, Window.unboundedFollowing)
    return columns.join(px.select(*KEYS, "v"), KEYS, "left").select(*KEYS, F.first("v", True).over(by).alias("v"))
