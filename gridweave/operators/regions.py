"""Connected regions of images and fills that work hole by hole.

Pixels are 4-connected if they hold the same value. A row of a region is found by windows over image rows, so
only runs, not pixels, enter the contraction.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators import tiles
from gridweave.operators.graph import connected
from gridweave.operators.pixels import KEYS, filled
from gridweave.storage import discard, materialise


def components(px: DataFrame, step: float = 0.0) -> DataFrame:
    """Adds lj, li (first pixel of the region in raster order) and size to each pixel that has a row.

    Neighbours belong together if their values differ by at most ``step`` (0: equal); nulls belong together.
    """
    close = lambda a, b: F.coalesce(F.abs(a - b) <= step, a.isNull() & b.isNull())
    row = Window.partitionBy("image_id", "j", "c").orderBy("i")
    before = F.lag(F.struct("i", "v")).over(row)
    starts = ~F.coalesce((before["i"] == F.col("i") - 1) & close(before["v"], F.col("v")), F.lit(False))
    runs = px.select(*KEYS, F.col("v").cast("double").alias("v")).withColumn("first", F.when(starts, F.col("i")))
    runs = materialise(runs.withColumn("first", F.last("first", True).over(row.rowsBetween(Window.unboundedPreceding, 0))))
    node = lambda j, i: F.struct("image_id", "c", F.col(j).alias("j"), F.col(i).alias("i"))
    below = runs.select("image_id", (F.col("j") - 1).alias("j"), "i", "c", F.col("v").alias("v2"), F.col("first").alias("f2"))
    touching = runs.join(below, KEYS).where(close(F.col("v"), F.col("v2"))).withColumn("j2", F.col("j") + 1)
    roots = connected(touching.select(node("j", "first").alias("a"), node("j2", "f2").alias("b")))
    named = runs.join(roots, node("j", "first") == F.col("node"), "left").select(*KEYS, "v", F.coalesce("root.j", "j").alias("lj"), F.coalesce("root.i", "first").alias("li"))
    sizes = named.groupBy("image_id", "c", "lj", "li").agg(F.count("*").alias("size"))
    return named.join(sizes, ["image_id", "c", "lj", "li"]).select(*KEYS, "v", "lj", "li", "size")


def region_list(px: DataFrame) -> DataFrame:
    """A row for each region: first pixel, value, size and number of its pixels with a 4-neighbour outside it."""
    d = components(px).select(*KEYS, "v", "lj", "li")
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    sent = d.select("image_id", "c", "lj", "li", "j", "i", sides.alias("o")).select("image_id", "c", "lj", "li", (F.col("j") + F.col("o.dy")).alias("j"), (F.col("i") + F.col("o.dx")).alias("i"))
    inside = sent.groupBy("image_id", "c", "lj", "li", "j", "i").agg(F.count("*").alias("near"))
    own = d.join(inside, ["image_id", "c", "lj", "li", "j", "i"], "left")
    return own.groupBy("image_id", "c", "lj", "li").agg(F.first("v").alias("v"), F.count("*").alias("size"), F.count_if(F.coalesce("near", F.lit(0)) < 4).alias("boundary"))


def remove_small(px: DataFrame, min_area: int, step: float = 0.0) -> DataFrame:
    """Pixels of regions of at most ``min_area`` pixels become null."""
    return components(px, step).select(*KEYS, F.when(F.col("size") > min_area, F.col("v")).alias("v"))


def mask_flat_regions(px: DataFrame, min_area: int) -> DataFrame:
    """Pixels of regions of one value with at least ``min_area`` pixels become null."""
    return components(px).select(*KEYS, F.when(F.col("size") < min_area, F.col("v")).alias("v"))


def fill_boundary(px: DataFrame, how: str = "avg") -> DataFrame:
    """Each connected hole of the domain takes the min, max or avg of the known pixels beside it, one that touches it on two sides counting twice."""
    full = materialise(filled(px).select(*KEYS, "v"))
    holes = components(full.where("v is null")).select(*KEYS, "lj", "li")
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    beside = full.where("v is not null").select("image_id", "c", "v", "j", "i", sides.alias("o")).select("image_id", "c", "v", (F.col("j") + F.col("o.dy")).alias("j"), (F.col("i") + F.col("o.dx")).alias("i"))
    value = beside.join(holes, KEYS).groupBy("image_id", "c", "lj", "li").agg({"avg": F.avg, "min": F.min, "max": F.max}[how]("v").alias("u"))
    inside = holes.join(value, ["image_id", "c", "lj", "li"], "left").select(*KEYS, "u")
    return full.join(inside, KEYS, "left").select(*KEYS, F.coalesce("v", "u").alias("v"))


def fill_harmonic(px: DataFrame, rounds: int = 20) -> DataFrame:
    """Holes of the domain relax towards the mean of their 4-neighbours inside it, from the mean of the image; known pixels stay."""
    full = filled(px).select(*KEYS, "v", F.col("v").isNull().alias("hole"))
    mean = px.groupBy("image_id", "c").agg(F.avg("v").alias("m"))
    state = full.join(mean, ["image_id", "c"]).select(*KEYS, F.coalesce("v", "m").alias("v"), "hole")
    row, column = Window.partitionBy("image_id", "j", "c").orderBy("i"), Window.partitionBy("image_id", "i", "c").orderBy("j")
    for k in range(rounds):
        near = [f("v").over(w) for w in (row, column) for f in (F.lag, F.lead)]
        total, n = (sum((F.coalesce(x, F.lit(0.0)) for x in near), F.lit(0.0)), sum((x.isNotNull().cast("int") for x in near), F.lit(0)))
        state = state.select(*KEYS, F.when(F.col("hole") & (n > 0), total / n).otherwise(F.col("v")).alias("v"), "hole")
        if k % 4 == 3:
            state = materialise(state)
    return state.select(*KEYS, "v")


def _relaxed(v: np.ndarray, hole: np.ndarray, there: np.ndarray, sweeps: int) -> np.ndarray:
    """Holes towards the mean of their neighbours by over-relaxation, black and white places in turn; the outer ring stays."""
    v = v.copy()
    n = max(v.shape)
    omega = 2 / (1 + math.sin(math.pi / (n + 1)))
    free = hole.copy()
    free[[0, -1], :] = free[:, [0, -1]] = False
    w = [np.pad(there, 1)[1 + y : 1 + y + v.shape[0], 1 + x : 1 + x + v.shape[1]].astype(float) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    count = np.maximum(sum(w), 1.0)
    colour = np.add.outer(np.arange(v.shape[0]), np.arange(v.shape[1])) % 2
    sets = [free & (colour == k) for k in (0, 1)]
    for _ in range(sweeps):
        for own in sets:
            pad = np.pad(v, 1)
            mean = (w[0] * pad[1:-1, 2:] + w[1] * pad[1:-1, :-2] + w[2] * pad[2:, 1:-1] + w[3] * pad[:-2, 1:-1]) / count
            v[own] += omega * (mean - v)[own]
    return v


def harmonic(px: DataFrame, tolerance: float = 1e-3, halo: int = 16, side: int = 64) -> DataFrame:
    """Holes of the domain become harmonic: each pixel in them is the mean of its 4-neighbours inside the domain, within ``tolerance`` over 1000; known pixels stay.

    Coarse to fine: an octave averages what is known of 2x2 pixels, down to one without holes; each finer one takes its parent's values and
    is then solved by overlapping tiles, which hold their surroundings fixed, over and over until no pixel moved by more. Rounds aren't fixed:
    the octaves leave little for them. Images with no known pixel keep their nulls.
    """
    small = tolerance / 1000
    levels = [materialise(filled(px).select(*KEYS, "v"))]
    while not levels[-1].where("v is null").isEmpty() and not levels[-1].where("i > 0 or j > 0").isEmpty():
        half = [F.floor(F.col(k) / 2).cast("int").alias(k) for k in ("j", "i")]
        levels.append(materialise(levels[-1].groupBy("image_id", *half, "c").agg(F.avg("v").alias("v"))))
    state = levels.pop().select(*KEYS, "v")

    def run(v: dict, known: dict) -> list:
        hole = known["hole"] & (v["hole"] > 0)
        there = known["hole"]
        guess = np.where(known["v"], v["v"], 0.0)
        solved = _relaxed(guess, hole & known["v"], there, 2 * max(guess.shape))
        inner = lambda m: tiles.moved(m, halo, 0, 0)
        return [(inner(solved), inner(known["v"])), (np.abs(inner(solved) - inner(guess)), inner(known["v"])), (inner(v["hole"]), inner(known["hole"]))]

    while levels:
        level = levels.pop()
        parent = state.select("image_id", "c", F.col("j").alias("pj"), F.col("i").alias("pi"), F.col("v").alias("pv"))
        d = level.withColumns({"pj": F.floor(F.col("j") / 2).cast("int"), "pi": F.floor(F.col("i") / 2).cast("int")}).join(parent, ["image_id", "c", "pj", "pi"], "left")
        now, moved = d.select(*KEYS, F.coalesce("v", "pv").alias("v"), F.col("v").isNull().cast("double").alias("hole")), None
        last = math.inf
        while moved is None or small < moved < last:  # it also ends where rounding keeps it from falling
            last = math.inf if moved is None else moved
            after = materialise(tiles.on_tiles(now, halo, run, columns=("v", "hole"), outputs=("v", "moved", "hole"), side=side))
            moved = after.where("hole > 0").agg(F.max("moved")).first()[0] or 0.0
            if "moved" in now.columns:
                discard(now)
            now = after
        discard(level)
        state = now
    return state.select(*KEYS, "v")
