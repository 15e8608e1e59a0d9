"""Fourier transforms, voting and registration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.pixels import pyramid, with_dims


def _lines(px: DataFrame, fixed: str, run: str, inverse: bool) -> DataFrame:
    """One-dimensional transform of each line of re, im, where missing places are 0: a group is one row or column of an image."""
    kind = px.schema["image_id"].dataType.simpleString()

    def turn(rows: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(int(rows["w" if run == "i" else "h"].iloc[0]), complex)
        z[rows[run]] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        z = np.fft.ifft(z) if inverse else np.fft.fft(z)
        same = {k: rows[k].iloc[0] for k in ("image_id", fixed, "w", "h")}
        return pd.DataFrame({**same, run: np.arange(len(z)), "re": z.real, "im": z.imag})[list(rows.columns)]

    return px.select("image_id", "j", "i", "w", "h", "re", "im").groupBy("image_id", fixed).applyInPandas(turn, f"image_id {kind}, j int, i int, w int, h int, re double, im double")


def dft2(px: DataFrame, inverse: bool = False) -> DataFrame:
    """Two-dimensional transform of channels 0 (real) and 1 (imaginary, may be absent): rows, then columns; no image is ever in one task. Missing pixels are 0."""
    at = lambda c: F.coalesce(F.max(F.when(F.col("c") == c, F.col("v"))), F.lit(0.0)).cast("double")
    z = px.groupBy("image_id", "j", "i").agg(at(0).alias("re"), at(1).alias("im"))
    z = _lines(_lines(with_dims(z), "j", "i", inverse), "i", "j", inverse)
    return z.select("image_id", "j", "i", F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("re").alias("v")), F.struct(F.lit(1).alias("c"), F.col("im").alias("v")))).alias("s")).select("image_id", "j", "i", "s.c", "s.v")


def autocorr(px: DataFrame, zero_mean: bool = True) -> DataFrame:
    """Circular autocorrelation of channel 0, from the squared modulus of the transform."""
    own = px.where("c = 0").select("image_id", "j", "i", "c", "v")
    if zero_mean:
        own = own.join(own.groupBy("image_id").agg(F.avg("v").alias("mean")), "image_id").select("image_id", "j", "i", "c", (F.col("v") - F.col("mean")).alias("v"))
    power = dft2(own).groupBy("image_id", "j", "i").agg(F.sum(F.col("v") * F.col("v")).alias("v")).withColumn("c", F.lit(0))
    return dft2(power, inverse=True).where("c = 0")


def hough(px: DataFrame, nt: int, nr: int, radius: float, least: float = 0.0) -> DataFrame:
    """Each pixel above ``least`` votes with its value on its whole sinusoid; sums before the shuffle."""
    d = px.where(F.col("v") > least).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))
    angle = F.col("t") * (math.pi / nt)
    rho = F.col("i") * F.cos(angle) + F.col("j") * F.sin(angle)
    return d.withColumn("r", F.floor((rho + radius) * nr / (2 * radius)).cast("int")).where(f"r between 0 and {nr - 1}").groupBy("image_id", "t", "r").agg(F.sum("v").alias("v"))


def hough_gradient(grad: DataFrame, nt: int, nr: int, radius: float) -> DataFrame:
    """Each pixel of ``image_id, j, i, gx, gy`` votes with its norm at the line across its gradient; opposite directions are one."""
    turn = F.atan2("gy", "gx")
    angle = F.when(turn < 0, turn + math.pi).otherwise(turn)
    d = grad.where("gx != 0 or gy != 0").withColumn("a", angle).withColumn("t", F.pmod(F.floor(F.col("a") * nt / math.pi), F.lit(nt)).cast("int"))
    d = d.withColumn("r", F.floor((F.col("i") * F.cos("a") + F.col("j") * F.sin("a") + radius) * nr / (2 * radius)).cast("int"))
    return d.where(f"r between 0 and {nr - 1}").groupBy("image_id", "t", "r").agg(F.sum(F.hypot("gx", "gy")).alias("v"))


def displacement_costs(a: DataFrame, b: DataFrame, moves: list[tuple[int, int]], each: bool = False) -> DataFrame:
    """Mean squared difference a(i, j) - b(i+dx, j+dy) for each move; ``a`` is sent to each place it is compared with. ``each``: images of one id by themselves."""
    by = ["image_id"] if each else []
    tried = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in moves)))
    sent = a.where("v is not null").select(*by, tried.alias("m"), "j", "i", "c", "v").select(*by, "m.dx", "m.dy", (F.col("j") + F.col("m.dy")).alias("j"), (F.col("i") + F.col("m.dx")).alias("i"), "c", "v")
    e = F.col("v") - F.col("w")
    return sent.join(b.where("v is not null").select(*by, "j", "i", "c", F.col("v").alias("w")), [*by, "j", "i", "c"]).groupBy(*by, "dx", "dy").agg(F.avg(e * e).alias("cost"), F.count("*").alias("n"))


def register_translation(a: DataFrame, b: DataFrame, scales: int = 3) -> tuple[int, int]:
    """Integer (dx, dy) at which b looks like a: at each octave from the coarsest the best of nine moves; one row per octave reaches the driver."""
    x = y = 0
    octaves = [pyramid(px, scales) for px in (a, b)]
    for k in reversed(range(scales)):
        moves = [(2 * x + dx, 2 * y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        costs = displacement_costs(*(o.where(F.col("octave") == k) for o in octaves), moves)
        best = costs.orderBy("cost", F.abs(F.col("dx")) + F.abs(F.col("dy")), "dx", "dy").first()
        x, y = (best.dx, best.dy) if best else (0, 0)
    return x, y
