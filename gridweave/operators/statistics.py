"""Statistics, histograms and contrast of pixel tables. Order statistics come from counted distinct values, so a large image is summed before it is ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators.neighbours import box_mean
from gridweave.operators.pixels import KEYS
from gridweave.storage import running


def histogram(px: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Exact histogram: v, n, and cum, the number up to v. Ranges of values are cumulated apart, so one large image is many tasks."""
    counts = px.where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    return running(counts, list(by), ["v"], "n", "cum")


def sort_samples(px: DataFrame, width: int) -> DataFrame:
    """All samples of each image in rising order, laid out in rows of ``width``."""
    d = running(px.where("v is not null").withColumn("one", F.lit(1)), ["image_id"], ["v", "c", "j", "i"], "one", "rank")
    place = F.col("rank") - 1
    return d.select("image_id", F.floor(place / width).cast("int").alias("j"), (place % width).cast("int").alias("i"), F.lit(0).alias("c"), "v")


def percentile_nr(px: DataFrame, percents: list[float], by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Order statistics at place floor((n-1) p / 100), never interpolated; a column q{p} for each."""
    h = histogram(px, by)
    total = h.groupBy(*by).agg(F.sum("n").alias("total"))
    h = h.join(total, list(by))
    return h.groupBy(*by).agg(*(F.min(F.when(F.col("cum") > F.floor((F.col("total") - 1) * (p / 100)), F.col("v"))).alias(f"q{p:g}") for p in percents))


def image_report(px: DataFrame) -> DataFrame:
    """One row for each image, and one for each channel of it (c is null for the whole)."""
    d = px.where("v is not null")
    return d.groupingSets([["image_id"], ["image_id", "c"]], "image_id", "c").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.stddev_pop("v").alias("sigma"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.avg(F.abs("v")).alias("mean_abs"), F.count_if(F.col("v") == 0).alias("zeros"), F.countDistinct("v").alias("different"))


def image_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """mse, rmse, mae, worst, ncc and psnr between images of one id over their common pixels."""
    d = a.select(*KEYS, "v").join(b.select(*KEYS, F.col("v").alias("w")), KEYS).where("v is not null and w is not null")
    e = F.col("v") - F.col("w")
    out = d.groupBy("image_id").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("worst"), F.corr("v", "w").alias("ncc"))
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(255 * 255 / F.col("mse"))))


def error_norm(a: DataFrame, p: float, b: DataFrame | None = None) -> DataFrame:
    """Mean p-norm (mean |e|^p)^(1/p) of a - b over the common known pixels of each image, or of a alone; the greatest error if p is infinite."""
    d = a.select(*KEYS, F.col("v").alias("e")) if b is None else a.select(*KEYS, "v").join(b.select(*KEYS, F.col("v").alias("w")), KEYS).select(*KEYS, (F.col("v") - F.col("w")).alias("e"))
    size = F.abs("e")
    return d.where("e is not null").groupBy("image_id").agg((F.max(size) if p == float("inf") else F.pow(F.avg(F.pow(size, F.lit(p))), F.lit(1 / p))).alias("error"))


def similarity(a: DataFrame, b: DataFrame, r: int, peak: float = 255.0) -> DataFrame:
    """ssim and uiqi between images of one id: means over the common known pixels of what the squares of side 2r+1 give.

    The five windowed moments come from one pass of sliding windows. ssim has the constants (0.01 peak)^2 and
    (0.03 peak)^2; uiqi has none, and leaves out squares where it is 0/0.
    """
    d = a.select(*KEYS, "v").join(b.select(*KEYS, F.col("v").alias("w")), KEYS).where("v is not null and w is not null")
    moments = {"x": F.col("v"), "y": F.col("w"), "xx": F.col("v") * F.col("v"), "yy": F.col("w") * F.col("w"), "xy": F.col("v") * F.col("w")}
    parts = d.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), e.alias("v")) for n, e in moments.items()))).alias("s"))
    means = box_mean(parts.select(F.struct("image_id", "s.name").alias("image_id"), "j", "i", "c", "s.v"), r)
    at = lambda n: F.max(F.when(F.col("image_id.name") == n, F.col("v"))).alias(n)
    m = means.groupBy(F.col("image_id.image_id").alias("image_id"), "j", "i", "c").agg(*(at(n) for n in moments))
    m = m.select(*KEYS, "x", "y", (F.col("xx") - F.col("x") * F.col("x")).alias("vx"), (F.col("yy") - F.col("y") * F.col("y")).alias("vy"), (F.col("xy") - F.col("x") * F.col("y")).alias("vxy"))

    def index(one: float, two: float):
        under = (F.col("x") * F.col("x") + F.col("y") * F.col("y") + one) * (F.col("vx") + F.col("vy") + two)
        return F.try_divide((2 * F.col("x") * F.col("y") + one) * (2 * F.col("vxy") + two), under)

    flat = (F.col("vx") + F.col("vy")) <= 1e-12 * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return m.groupBy("image_id").agg(F.avg(index((0.01 * peak) ** 2, (0.03 * peak) ** 2)).alias("ssim"), F.avg(F.when(~flat, index(0.0, 0.0))).alias("uiqi"))


def histo_mode(px: DataFrame, size: float, phase: float = 0.0, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Centre of the fullest bin; ties to the lower."""
    bins = px.where("v is not null").groupBy(*by, F.floor((F.col("v") - phase) / size + 0.5).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy(*by).agg((F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))) * size + phase).alias("mode"), F.max("n").alias("n"))


def transport_distance(a: DataFrame, b: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Earth mover's distance between the normalised histograms of images of one id, in bins."""
    def cumulated(px: DataFrame, name: str) -> DataFrame:
        k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) * bins / (hi - lo)))).cast("int")
        return px.where("v is not null").groupBy("image_id", k.alias("bin")).agg(F.count("*").alias(name))

    both = cumulated(a, "p").join(cumulated(b, "q"), ["image_id", "bin"], "full").na.fill(0, ["p", "q"])
    ids = both.groupBy("image_id").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    grid = ids.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(both, ["image_id", "bin"], "left").na.fill(0, ["p", "q"])
    by = Window.partitionBy("image_id").orderBy("bin")
    gap = F.abs(F.sum("p").over(by) / F.col("np") - F.sum("q").over(by) / F.col("nq"))
    return grid.where("np > 0 and nq > 0").withColumn("gap", gap).groupBy("image_id").agg(F.sum("gap").alias("distance"))


def posmax(px: DataFrame) -> DataFrame:
    """Coordinates of the largest sample, the first in raster order on ties."""
    d = px.where("v is not null").groupBy("image_id").agg(F.max_by(F.struct("j", "i", "v"), F.struct(F.col("v"), -F.col("j"), -F.col("i"))).alias("x"))
    return d.select("image_id", "x.j", "x.i", "x.v")


def hist2d(points: DataFrame, width: int, scale: float) -> DataFrame:
    """Counts of 2-vectors x, y in a square of bins around 0; outside dropped."""
    at = lambda k: F.floor(F.col(k) * scale + width / 2).cast("int")
    return points.select(at("x").alias("i"), at("y").alias("j")).where(f"i between 0 and {width - 1} and j between 0 and {width - 1}").groupBy("j", "i").agg(F.count("*").alias("n"))


def qeasy(px: DataFrame, black: float, white: float, keep_float: bool = False) -> DataFrame:
    """Linear map of black..white to 0..255, clamped."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255.0 * (F.col("v") - black) / (white - black)))
    return px.withColumn("v", x if keep_float else F.floor(x).cast("double"))


def qauto(px: DataFrame, percent: float = 5.0) -> DataFrame:
    """Stretch each image so that ``percent`` saturates at both ends."""
    ends = percentile_nr(px, [percent, 100 - percent]).toDF("image_id", "lo", "hi")
    x = F.when(F.col("hi") > F.col("lo"), 255.0 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(127.0)
    return px.join(ends, "image_id").select(*KEYS, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).cast("double").alias("v"))


def histeq(px: DataFrame) -> DataFrame:
    """Each value becomes the share of samples of its image in its bin of 256 or lower ones."""
    ends = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(255), F.floor((F.col("v") - F.col("lo")) * 256 / (F.col("hi") - F.col("lo"))))).otherwise(0).cast("int")
    d = px.where("v is not null").join(ends, "image_id").withColumn("bin", bin_)
    counts = d.groupBy("image_id", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("image_id")
    cdf = counts.select("image_id", "bin", (F.sum("n").over(whole.orderBy("bin")) / F.sum("n").over(whole)).alias("cdf"))
    return d.join(cdf, ["image_id", "bin"]).select(*KEYS, F.col("cdf").alias("v"))


def colormatch(a: DataFrame, b: DataFrame, each: bool = False) -> DataFrame:
    """Each channel of a moved and scaled to the mean and deviation of b, both over the pixels that both have; ``each``: images of one id by themselves."""
    by = ["image_id"] if each else []
    d = a.select(*KEYS, "v").join(b.select(*by, "j", "i", "c", F.col("v").alias("w")), [*by, "j", "i", "c"]).where("v is not null and w is not null")
    s = d.groupBy(*by, "c").agg(F.avg("v").alias("ma"), F.avg("w").alias("mb"), F.stddev_pop("v").alias("sa"), F.stddev_pop("w").alias("sb"))
    return a.join(s, [*by, "c"]).select(*KEYS, ((F.col("v") - F.col("ma")) * F.coalesce(F.try_divide("sb", "sa"), F.lit(1.0)) + F.col("mb")).alias("v"))
