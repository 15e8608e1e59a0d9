"""Motion between images of one id, bursts, blurs that vary from pixel to pixel, and transforms of sliding frames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators import tiles
from gridweave.operators.neighbours import CENTRED, box_mean, stencil
from gridweave.operators.pixels import KEYS
from gridweave.storage import discard, materialise


def _moves(moves: list[tuple[int, int]]):
    return F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in moves)))


def channel_costs(a: DataFrame, b: DataFrame, moves: list[tuple[int, int]], missing: float = 1000.0) -> DataFrame:
    """Mean over pixels and channels of a of the squared difference to b(i+dx, j+dy) for each image and move; a sample without a partner costs ``missing``."""
    sent = a.where("v is not null").select("image_id", "j", "i", "c", "v", _moves(moves).alias("m")).select("image_id", "m.dx", "m.dy", (F.col("j") + F.col("m.dy")).alias("j"), (F.col("i") + F.col("m.dx")).alias("i"), "c", "v")
    met = sent.join(b.where("v is not null").select(*KEYS, F.col("v").alias("w")), KEYS, "left")
    e = F.col("v") - F.col("w")
    return met.groupBy("image_id", "dx", "dy").agg(F.avg(F.coalesce(e * e, F.lit(missing))).alias("cost"))


def block_match(a: DataFrame, b: DataFrame, r: int, moves: list[tuple[int, int]]) -> DataFrame:
    """For each pixel of a the move whose squared differences to b(i+dx, j+dy) have the least mean in the square of side 2r+1; ties to the shortest, then the least."""
    sent = a.where("v is not null").select("image_id", "j", "i", "c", "v", _moves(moves).alias("m"))
    sent = sent.select("image_id", "j", "i", "c", "v", "m.dx", "m.dy").withColumn("tj", F.col("j") + F.col("dy")).withColumn("ti", F.col("i") + F.col("dx"))
    other = b.where("v is not null").select("image_id", F.col("j").alias("tj"), F.col("i").alias("ti"), "c", F.col("v").alias("w"))
    met = sent.join(other, ["image_id", "tj", "ti", "c"])
    e = F.col("v") - F.col("w")
    costs = box_mean(met.select(F.struct("image_id", "dx", "dy").alias("image_id"), "j", "i", "c", (e * e).alias("v")), r)
    m = F.struct("v", (F.abs("image_id.dx") + F.abs("image_id.dy")).alias("far"), F.col("image_id.dx").alias("dx"), F.col("image_id.dy").alias("dy"))
    best = costs.groupBy(F.col("image_id.image_id").alias("image_id"), "j", "i", "c").agg(F.min(m).alias("m"))
    return best.select("image_id", "j", "i", "c", "m.dx", "m.dy", F.col("m.v").alias("cost"))


#: Moves that a scale tries about what it was given, in the order that settles ties.
NEAR = [(0, 0), (-1, 0), (0, -1), (0, 1), (1, 0)]


def _halved(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", F.floor(F.col("j") / 2).cast("int").alias("j"), F.floor(F.col("i") / 2).cast("int").alias("i"), "c").agg(F.avg("v").alias("v"))


def _bits(x: np.ndarray) -> np.ndarray:
    """For each sample a plane of which of its eight neighbours are greater; beyond the border none."""
    pad = np.pad(x, 1, constant_values=-np.inf)
    return np.stack([tiles.moved(pad, 1, dx, dy) > x for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy])


def _window_costs(a: np.ndarray, b: np.ndarray, halo: int, r: int, dx: np.ndarray, dy: np.ndarray, cost: str) -> np.ndarray:
    """Cost of moving each inner place by its own dx, dy, summed over the square of side 2r+1; a and b hold 0 where nothing is known."""
    h, w = dx.shape
    y, x = np.mgrid[halo : halo + h, halo : halo + w]
    total = np.zeros((h, w))
    pick = {"squares": lambda p, q, s, t: (a[p, q] - b[s, t]) ** 2, "sign": lambda p, q, s, t: (a[p, q] > a[y, x]) != (b[s, t] > b[y + dy, x + dx])}
    if cost == "census":
        ca, cb = _bits(a), _bits(b)
        pick["census"] = lambda p, q, s, t: (ca[:, p, q] != cb[:, s, t]).sum(0)
    for oy in range(-r, r + 1):
        for ox in range(-r, r + 1):
            total += pick[cost](y + oy, x + ox, y + oy + dy, x + ox + dx)
    return total


def _vector_median(dx: np.ndarray, dy: np.ndarray, known: np.ndarray, reach: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the known moves in the square of side 2r+1 the one with the least sum of distances to the others; ties to the first in raster order."""
    at = [(x, y) for y in range(-r, r + 1) for x in range(-r, r + 1)]
    xs, ys, ks = (np.stack([tiles.moved(m, reach, *o) for o in at]) for m in (dx, dy, known))
    sums = np.stack([np.where(ks, np.hypot(xs - xs[k], ys - ys[k]), 0.0).sum(0) for k in range(len(at))])
    best = np.where(ks, sums, np.inf).argmin(0)[None]
    return np.take_along_axis(xs, best, 0)[0], np.take_along_axis(ys, best, 0)[0]


def block_match_scales(a: DataFrame, b: DataFrame, r: int, scales: int, median: int = 1, cost: str = "squares") -> DataFrame:
    """For each pixel of a the move dx, dy to b, coarse to fine over ``scales`` octaves: image_id, j, i, dx, dy, cost.

    The coarsest octave begins with no move, each finer one with twice the move of the pixel's parent, after a vector
    median over the square of side 2 * ``median`` + 1. Each scale tries five moves about that and keeps the cheapest in the square of side 2r+1,
    summed over all channels: by ``squares`` of differences, by ``sign`` (comparisons with the centre that differ) or by
    ``census`` (bits of the eight neighbours that differ). What isn't known is 0, as is everything beyond the border.

    Moves at a scale are bounded by 2^octaves, so a tile with that halo finds all of b that its pixels can ask for: two exchanges of tiles a scale.
    """
    if cost not in ("squares", "sign", "census"):
        raise ValueError(f"unknown cost {cost}")
    channels = sorted(r_["c"] for r_ in a.select("c").distinct().collect()) or [0]  # channels of a pixel
    levels = [(a.select(*KEYS, F.col("v").cast("double").alias("v")), b.select(*KEYS, F.col("v").cast("double").alias("v")))]
    for _ in range(scales - 1):
        levels.append(tuple(materialise(_halved(x)) for x in levels[-1]))
    names = tuple(f"{n}{k}" for k in range(len(channels)) for n in "ab")
    moves = None
    for octave in range(scales - 1, -1, -1):
        one, two = levels[octave]
        most = 2 ** (scales - octave) - 1  # how long a move can be here
        at = lambda px, n: px.groupBy("image_id", "j", "i").agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"{n}{k}") for k, c in enumerate(channels)))  # noqa: E731, B023
        px = at(one, "a").withColumn("here", F.lit(True)).join(at(two, "b"), ["image_id", "j", "i"], "full").withColumn("here", F.coalesce("here", F.lit(False)))
        if moves is None:
            px = px.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0)})
        else:
            parent = moves.select("image_id", F.col("j").alias("pj"), F.col("i").alias("pi"), (2 * F.col("dx")).alias("dx"), (2 * F.col("dy")).alias("dy"))
            px = px.withColumns({"pj": F.floor(F.col("j") / 2).cast("int"), "pi": F.floor(F.col("i") / 2).cast("int")}).join(parent, ["image_id", "pj", "pi"], "left")
        px = px.withColumn("c", F.lit(0))
        halo = max(most + 2 * r + 2, median)

        def run(v: dict, known: dict, halo: int = halo, first: bool = moves is None) -> list:
            inner = lambda m: tiles.moved(m, halo, 0, 0)
            dx, dy = inner(v["dx"]), inner(v["dy"])
            if not first and median:
                dx, dy = _vector_median(v["dx"], v["dy"], known["dx"], halo, median)
            dx, dy = np.rint(dx).astype(int), np.rint(dy).astype(int)
            planes = [tuple(np.where(known[f"{n}{k}"], v[f"{n}{k}"], 0.0) for n in "ab") for k in range(len(channels))]
            costs = np.stack([sum(_window_costs(p, q, halo, r, dx + x, dy + y, cost) for p, q in planes) for x, y in NEAR])
            best = costs.argmin(0)
            step = np.array(NEAR)[best]
            there = np.ones(dx.shape, bool)
            return [(dx + step[..., 0], there), (dy + step[..., 1], there), (costs.min(0), there)]

        found = materialise(tiles.on_tiles(px, halo, run, columns=(*names, "dx", "dy"), outputs=("dx", "dy", "cost")))
        if moves is not None:
            discard(moves)
        moves = found
    discard(*(x for level in levels[1:] for x in level))
    return moves.select("image_id", "j", "i", F.col("dx").cast("int").alias("dx"), F.col("dy").cast("int").alias("dy"), "cost")


def least_squares_flow(a: DataFrame, b: DataFrame, r: int) -> DataFrame:
    """Local flow u, w from a to b: the 2x2 system of windowed sums of centred gradients of a and of b - a; null where it has no solution."""
    gx = stencil(a, CENTRED, "i").withColumnRenamed("v", "gx")
    gy = stencil(a, CENTRED, "j").withColumnRenamed("v", "gy")
    d = a.select(*KEYS, "v").join(b.select(*KEYS, F.col("v").alias("w")), KEYS).join(gx, KEYS).join(gy, KEYS).withColumn("gt", F.col("w") - F.col("v"))
    products = {"xx": ("gx", "gx"), "xy": ("gx", "gy"), "yy": ("gy", "gy"), "xt": ("gx", "gt"), "yt": ("gy", "gt")}
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (F.col(p) * F.col(q)).alias("v")) for n, (p, q) in products.items())))
    means = box_mean(d.select(*KEYS, parts.alias("s")).select(F.struct("image_id", "s.name").alias("image_id"), "j", "i", "c", "s.v"), r)
    at = lambda n: F.max(F.when(F.col("image_id.name") == n, F.col("v"))).alias(n)
    m = means.groupBy(F.col("image_id.image_id").alias("image_id"), "j", "i", "c").agg(*(at(n) for n in products))
    xx, xy, yy, xt, yt = (F.col(n) for n in products)
    det = xx * yy - xy * xy
    return m.select(*KEYS, F.when(det > 1e-9, (xy * yt - yy * xt) / det).alias("u"), F.when(det > 1e-9, (xy * xt - xx * yt) / det).alias("w"))


def lucky_rank(frames: DataFrame, r: int, k: int) -> DataFrame:
    """For each pixel the value of the frame that is the k-th nearest (from 1) to the mean image, by squared difference in the square of side 2r+1; ties to the first frame."""
    mean = frames.groupBy("j", "i", "c").agg(F.avg("v").alias("m"))
    gap = frames.select(*KEYS, "v").join(mean, ["j", "i", "c"]).withColumn("e", (F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))
    near = box_mean(gap.select(*KEYS, F.col("e").alias("v")), r).withColumnRenamed("v", "d")
    place = F.row_number().over(Window.partitionBy("j", "i", "c").orderBy(F.round("d", 6), "image_id"))  # a pixel has as many rows as frames
    return gap.join(near, KEYS).withColumn("nth", place).where(F.col("nth") == k).select("j", "i", "c", "v", F.col("image_id").alias("frame"))


def local_gaussian(px: DataFrame, sigma: DataFrame, most: int = 19) -> DataFrame:
    """Gaussian mean of the known pixels with the width that ``sigma`` has at the pixel; below 0.1 it stays. Kernels reach ceil(3 sigma), at most ``most``.

    Pixels without a row in ``sigma`` are left out, a null width gives null; both still count for others.
    """
    asked = px.select(*KEYS, "v").join(sigma.select("image_id", "j", "i", F.col("v").alias("s"), F.lit(True).alias("here")), ["image_id", "j", "i"], "left")

    def run(v: dict, known: dict) -> list:
        s, ok = tiles.moved(v["s"], most, 0, 0), tiles.moved(known["s"], most, 0, 0)
        reach = np.where(s < 0.1, 0, np.minimum(most, np.ceil(3 * s)))
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where(s < 0.1, 0.0, 1 / (2 * s * s))
        top, below, far = np.zeros(s.shape), np.zeros(s.shape), int(reach[ok].max(initial=0))
        for dy in range(-far, far + 1):
            for dx in range(-far, far + 1):
                w = np.where(tiles.moved(known["v"], most, dx, dy) & (reach >= max(abs(dx), abs(dy))), np.exp(-(dx * dx + dy * dy) * rate), 0.0)
                top += w * tiles.moved(v["v"], most, dx, dy)
                below += w
        with np.errstate(divide="ignore", invalid="ignore"):
            return [(top / below, ok & (below > 0))]

    return tiles.on_tiles(asked.withColumn("here", F.coalesce("here", F.lit(False))), most, run, columns=("v", "s"))


def windowed_spectrum(series: DataFrame, by: str, at: str, length: int) -> DataFrame:
    """Discrete Fourier transform of each frame of ``length`` places that starts at a known one: by, start, k, re, im; absent places count as 0."""
    sent = series.select(by, F.col(at).alias("at_"), "v", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("n"))
    sent = sent.select(by, (F.col("at_") - F.col("n")).alias("start"), "n", "v").join(series.select(by, F.col(at).alias("start")).distinct(), [by, "start"], "left_semi")
    d = sent.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    angle = 2 * math.pi / length * F.col("k") * F.col("n")
    return d.groupBy(by, "start", "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), (-F.sum(F.col("v") * F.sin(angle))).alias("im"))
