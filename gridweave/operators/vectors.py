"""Vector samples: accumulators over stacks of vector images, and packing of channels.

Pixels are rows ``image_id, j, i, c, v``; the channels c of one pixel are a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.accumulate import accumulate
from gridweave.operators.blocks import PAIRS, distances, matrix, meet
from gridweave.storage import discard, materialise

#: Samples of a cell up to which pairs are rows of a join.
FEW = 32


def accumulate_vec(px: DataFrame, op: str) -> DataFrame:
    """One vector per cell j, i from those of all images: sum, avg, mul, modc (mode of each channel), cprod (complex product), med (medoid).

    Nulls are left out. The medoid has the least sum of distances to the others, the first image on ties (sums that
    differ by rounding alone); it compares all pairs of a cell, of which there is one sample for each image.
    """
    px = px.where(F.col("v").isNotNull())
    if op in ("sum", "avg", "mul"):
        return px.groupBy("j", "i", "c").agg({"sum": F.sum, "avg": F.avg, "mul": F.product}[op]("v").alias("v"))
    if op == "modc":
        return accumulate(px, "mod", by=("j", "i", "c"))
    at = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    if op == "cprod":
        z = px.where("c in (0, 1)").groupBy("image_id", "j", "i").agg(at(0).alias("re"), at(1).alias("im")).where("re is not null and im is not null")
        z = z.groupBy("j", "i").agg(F.product(F.hypot("re", "im")).alias("r"), F.sum(F.atan2("im", "re")).alias("t"))
        parts = F.array(F.struct(F.lit(0).alias("c"), (F.col("r") * F.cos("t")).alias("v")), F.struct(F.lit(1).alias("c"), (F.col("r") * F.sin("t")).alias("v")))
        return z.select("j", "i", F.explode(parts).alias("s")).select("j", "i", "s.c", "s.v")
    if op == "med":
        return _medoid(px)
    raise ValueError(f"unknown vector accumulator {op}")


def _sums(exact: bool):
    """For ``meet``: of each vector the sum of distances to the other table's, and how far off it may be."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        u, v, w = matrix(x["descr"]), matrix(y["descr"]), y["n"].to_numpy().astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            nu, nv = (u * u).sum(1), (v * v).sum(1)
            off = max(1e-15 * (u.shape[1] + 16) * (nu.max() + nv.max()), 1e-300)
        plain = exact or not off < np.inf  # no product of what isn't finite, or overflows
        d, e, step = np.zeros(len(u)), np.zeros(len(u)), max(1, PAIRS // len(v))
        for k in range(0, len(u), step):
            part = slice(k, k + step)
            if plain:
                with np.errstate(invalid="ignore"):
                    d[part] = (distances(u[part, None], v) * w).sum(1)
                continue
            s = nv - u[part] @ (2 * v.T)
            s += nu[part, None]
            np.sqrt(np.maximum(s, off, out=s), out=s)
            d[part] = s @ w
            e[part] = np.divide(off, s, out=s) @ w
        return pa.table({**{k: x[k] for k in ("j", "i", "id")}, "d": d, "e": e + 1e-15 * len(v) * d})

    return run


def _medoid(px: DataFrame) -> DataFrame:
    """Cells of few samples are joined with themselves. In the others equal vectors are one with a weight; sums come from
    products in blocks, and those of all that may be the least, within the rounding, once more from plain distances."""
    cell, fields = ["j", "i"], px.schema
    vectors = materialise(px.groupBy("image_id", "j", "i").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("x")))  # as many as channels
    sizes = vectors.groupBy(*cell).agg(F.count("*").alias("all"))
    few = vectors.join(sizes.where(F.col("all") <= FEW), cell, "left_semi")
    other = few.select("j", "i", F.col("x").alias("y"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a["v"] - b["v"]) * (a["v"] - b["v"])), F.lit(0.0), lambda s, d: s + d))
    sums = few.join(other, cell).groupBy("image_id", *cell).agg(F.sum(gap).alias("d")).select(*cell, F.col("image_id").alias("id"), "d")
    many = vectors.join(sizes.where(F.col("all") > FEW), cell, "left_semi").withColumn("descr", F.transform("x", lambda s: s["v"].cast("double")))
    many = materialise(many.groupBy(*cell, "descr").agg(F.min("image_id").alias("id"), F.count("*").alias("n")).withColumn("dims", F.size("descr")))
    key, right = [*cell, "dims"], many.select("j", "i", "dims", "id", "descr", "n")
    schema = ", ".join(f"{to} {fields[k].dataType.simpleString()}" for k, to in (("j", "j"), ("i", "i"), ("image_id", "id"))) + ", d double, e double"
    total = lambda d, exact: meet(d, right, key, _sums(exact), schema, 2).groupBy(*cell, "id").agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    rough = materialise(total(right, False))
    low = rough.groupBy(*cell).agg(F.min(F.col("d") + F.col("e")).alias("low"))
    left = rough.join(low, cell).where((F.col("d") - F.col("e") <= F.col("low")) | (F.col("d") <= F.col("low"))).select(*cell, "id")
    sums = materialise(sums.unionByName(total(right.join(left, [*cell, "id"], "left_semi"), True).drop("e")))
    low = sums.groupBy(*cell).agg(F.min("d").alias("low"))
    first = sums.join(low, cell).where(F.col("d") <= F.col("low") * (1 + 1e-13)).groupBy(*cell).agg(F.min("id").alias("image_id"))
    best = materialise(vectors.join(first, [*cell, "image_id"]).select(*cell, "x"))
    discard(vectors, many, rough, sums)
    return best.select("j", "i", F.explode("x").alias("s")).select("j", "i", "s.c", "s.v")


def stack_channels(*images: DataFrame) -> DataFrame:
    """Channels of several tables one after another; an image must be in each."""
    out, ids = None, None
    for px in images:
        size = px.agg((F.max("c") + 1).alias("n"))
        own = px.select("image_id", "j", "i", "c", "v")
        if out is None:
            out, before = own, size
        else:
            out = out.unionByName(own.join(F.broadcast(before), how="cross").select("image_id", "j", "i", (F.col("c") + F.coalesce("n", F.lit(0))).alias("c"), "v"))  # one row
            before = before.select(F.col("n").alias("m")).join(size, how="cross").select((F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
        ids = px.select("image_id").distinct() if ids is None else ids.join(px.select("image_id").distinct(), "image_id")
    return out.join(ids, "image_id", "left_semi")


def halve(px: DataFrame) -> DataFrame:
    """Each image becomes two, ``image_id/0`` and ``image_id/1``, of the first and the second half of its channels; an odd last one is dropped."""
    n = px.groupBy("image_id").agg(F.floor((F.max("c") + 1) / 2).cast("int").alias("half"))
    d = px.join(n, "image_id").where("half > 0 and c < 2 * half").withColumn("part", F.floor(F.col("c") / F.col("half")).cast("int"))
    return d.select(F.concat_ws("/", F.col("image_id").cast("string"), F.col("part").cast("string")).alias("image_id"), "j", "i", (F.col("c") - F.col("part") * F.col("half")).alias("c"), "v")


def interleave(px: DataFrame, back: bool = False) -> DataFrame:
    """Channels a0..an b0..bn become a0 b0 .. an bn, or back."""
    n = px.groupBy("image_id").agg(F.floor((F.max("c") + 1) / 2).cast("int").alias("half"))
    c, half = F.col("c"), F.col("half")
    to = c % 2 * half + F.floor(c / 2) if back else c % half * 2 + F.floor(c / half)
    return px.join(n, "image_id").where("half > 0 and c < 2 * half").select("image_id", "j", "i", to.cast("int").alias("c"), "v")


def magnitudes(px: DataFrame) -> DataFrame:
    """Per image: least, greatest and mean norm of its vector pixels, their number and how many differ."""
    pixel = px.where("v is not null").groupBy("image_id", "j", "i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("x"))
    return pixel.groupBy("image_id").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"), F.avg("norm").alias("mean_norm"), F.count("*").alias("pixels"), F.countDistinct("x").alias("different_pixels"))

