"""Casts, palettes and automatic contrast of signed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.pixels import KEYS
from gridweave.operators.statistics import histogram

#: Ranges of the sample types.
RANGES = {"u8": (0, 255), "u16": (0, 65535), "i16": (-32768, 32767), "i32": (-2147483648, 2147483647)}


def cast_samples(px: DataFrame, kind: str) -> DataFrame:
    """u8, u16, i16, i32: cut to the type's range and rounded down; f32: single precision; f64: as they are."""
    if kind == "f64":
        return px
    if kind == "f32":
        return px.withColumn("v", F.col("v").cast("float").cast("double"))
    lo, hi = RANGES[kind]
    return px.withColumn("v", F.floor(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col("v")))).cast("double"))


def _channels(px: DataFrame, rgb: list[Column]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(k).alias("c"), x.cast("double").alias("v")) for k, x in enumerate(rgb)))
    return px.select("image_id", "j", "i", F.explode(parts).alias("s")).select("image_id", "j", "i", "s.c", "s.v")


def sauto(px: DataFrame, percent: float = 5.0) -> DataFrame:
    """Signed values as colours from blue over white to red; the largest ``percent`` of absolute values saturate; missing ones are gray."""
    ranked = histogram(px.select("image_id", F.abs("v").alias("v")))
    total = ranked.groupBy("image_id").agg(F.sum("n").alias("total"))
    place = F.greatest(F.lit(0), (F.col("total") - 1 - percent * F.col("total") / 100).cast("long"))
    top = ranked.join(total, "image_id").groupBy("image_id").agg(F.min(F.when(F.col("cum") > place, F.col("v"))).alias("top"))
    d = px.where("c = 0").join(top, "image_id", "left")
    x = F.try_divide("v", "top")
    clip = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))
    rgb = [1 - clip(x, 0.0, 1.0), 1 - clip(F.abs(x), 0.0, 1.0), 1 + clip(x, -1.0, 0.0)]
    return _channels(d, [F.when(F.col("v").isNull() | x.isNull(), 100).otherwise(F.floor(255 * k)) for k in rgb])


def apply_palette(px: DataFrame, lo: float, hi: float, nodes: list[tuple[float, float, float]]) -> DataFrame:
    """Gray to RGB: the colours ``nodes`` stand at equal distances from lo to hi, linear between them; missing pixels are black."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - lo) / (hi - lo))) * (len(nodes) - 1)
    at = F.least(F.floor(x), F.lit(len(nodes) - 2))
    rgb = []
    for k in range(3):
        table = F.array(*(F.lit(float(n[k])) for n in nodes))
        a, b = F.get(table, at.cast("int")), F.get(table, at.cast("int") + 1)
        rgb.append(F.coalesce(F.floor(a + (b - a) * (x - at)), F.lit(0)))
    return _channels(px.where("c = 0"), rgb)


def hot(px: DataFrame, lo: float, hi: float) -> DataFrame:
    """Gray to RGB: red rises three times as fast as green and blue; missing pixels are black."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255.0 * (F.col("v") - lo) / (hi - lo)))
    zero = lambda c: F.coalesce(F.floor(c), F.lit(0))
    return _channels(px.where("c = 0"), [zero(F.least(F.lit(255.0), 3 * x)), zero(x), zero(x)])


def rgb_to_hsv(px: DataFrame) -> DataFrame:
    """Channels 0 to 2 from red, green, blue in 0..1 to hue (0..360), saturation and value."""
    at = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    d = px.groupBy("image_id", "j", "i").agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    gap = hi - lo
    r, g, b = (F.col(k) for k in "rgb")
    hue = F.when(gap == 0, 0.0).when(hi == r, F.pmod(60 * (g - b) / gap, F.lit(360.0))).when(hi == g, 60 * (b - r) / gap + 120).otherwise(60 * (r - g) / gap + 240)
    return _channels(d, [hue, F.when(hi == 0, 0.0).otherwise(gap / hi), hi])
