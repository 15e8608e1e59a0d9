"""Accumulators: the samples of each cell over a stack of images become one value. Nulls are left out; no samples give null.

Accumulators of order (med, medv, iqd, q) count equal values and rank them by ranges, so that no cell has to be in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.order_statistics import accumulated, places_of
from gridweave.operators.pixels import log_average


def _power_mean(p: float) -> Column:
    if p == 0:
        return log_average()
    if math.isinf(p):
        return F.max("v") if p > 0 else F.min("v")
    return F.pow(F.avg(F.pow("v", F.lit(p))), F.lit(1 / p))


def _gini(p: float, q: float) -> Column:
    v = F.col("v")
    if p == q:
        return F.exp(F.sum(F.pow(v, F.lit(p)) * F.ln(v)) / F.sum(F.pow(v, F.lit(p))))
    return F.pow(F.sum(F.pow(v, F.lit(p))) / F.sum(F.pow(v, F.lit(q))), F.lit(1 / (p - q)))


def aggregate(op: str, order: str = "image_id") -> Column:
    """The aggregate of an operator's name: sum mul avg min max cnt first rnd euc geo har lav std, M{p}, L{p}, G{p,q}. What rnd draws hangs on a hash, so that a task run again draws the same."""
    v = F.col("v")
    plain = {
        "sum": lambda: F.sum("v"), "mul": lambda: F.product("v"), "avg": lambda: F.avg("v"), "min": lambda: F.min("v"), "max": lambda: F.max("v"),
        "cnt": lambda: F.count("v"),
        "first": lambda: F.min_by("v", F.when(v.isNotNull(), F.col(order))), "euc": lambda: F.sqrt(F.avg(v * v)), "geo": log_average,
        "har": lambda: F.when(F.count_if(v == 0) > 0, 0.0).otherwise(F.count("v") / F.sum(F.try_divide(F.lit(1.0), v))), "lav": log_average,
        "std": lambda: F.stddev_pop("v"), "rnd": lambda: F.min_by("v", F.struct(F.xxhash64(F.lit(17), order, "j", "i", "v"), F.col(order))),
    }
    if op in plain:
        return plain[op]()
    kind, arg = op[0], op[1:]
    if kind == "M":
        return _power_mean(float(arg))
    if kind == "L":
        return F.sum(F.pow(v, F.lit(float(arg)))) / F.sum(F.pow(v, F.lit(float(arg) - 1)))
    if kind == "G":
        return _gini(*map(float, arg.split(",")))
    raise ValueError(f"unknown accumulator {op}")


def accumulate(px: DataFrame, op: str, by: tuple[str, ...] = ("j", "i"), order: str = "image_id") -> DataFrame:
    """One value per cell, by one of the names of ``aggregate`` or med medv iqd q{percent} lse pmin pmax mod H{width}. Sums, counts and extrema combine before the shuffle."""
    px = px.where(F.col("v").isNotNull())
    if places_of(op):
        return accumulated(px, [op], by).withColumnRenamed(op, "v")
    if op in ("pmin", "pmax"):
        return _place_of_extremum(px, op, by, order)
    if op == "lse":  # less the greatest, so that no exponential overflows
        shifted = px.join(px.groupBy(*by).agg(F.max("v").alias("top")), list(by))
        return shifted.groupBy(*by).agg((F.first("top") + F.ln(F.avg(F.exp(F.col("v") - F.col("top"))))).alias("v"))
    if op == "mod":
        return _mode(px, by, F.col("v"))
    if op[0] == "H":
        return _mode(px, by, F.floor(F.col("v") / float(op[1:])) * float(op[1:]))
    return px.groupBy(*by).agg(aggregate(op, order).alias("v"))


def accumulate_many(px: DataFrame, ops: list[str], by: tuple[str, ...] = ("j", "i"), order: str = "image_id") -> DataFrame:
    """Several accumulators, a column for each: those of order by one ranking, the others in one shuffle."""
    px = px.where(F.col("v").isNotNull())
    ranked = [op for op in ops if places_of(op)]
    plain = [op for op in ops if op not in ranked]
    parts = [px.groupBy(*by).agg(*(aggregate(op, order).alias(op) for op in plain))] if plain else []
    parts += [accumulated(px, ranked, by)] if ranked else []
    return (parts[0].join(parts[1], list(by)) if len(parts) == 2 else parts[0]).select(*by, *ops)


def _place_of_extremum(px: DataFrame, op: str, by: tuple[str, ...], order: str) -> DataFrame:
    """How many samples of the cell go before its first extreme one in ``order``: counted, never sorted."""
    ends = px.groupBy(*by).agg((F.min if op == "pmin" else F.max)("v").alias("end"))
    firsts = px.join(ends, list(by)).groupBy(*by).agg(F.min(F.when(F.col("v") == F.col("end"), F.col(order))).alias("first"))
    return px.join(firsts, list(by)).groupBy(*by).agg(F.count_if(F.col(order) < F.col("first")).cast("double").alias("v"))


def _mode(px: DataFrame, by: tuple[str, ...], level: Column) -> DataFrame:
    """256 bins of whole levels (cut towards 0), smoothed 1-2-1; other levels don't count; bin 128 wins ties and where nothing counts, else the lowest."""
    inside = (level > -1) & (level < 256)
    at = F.when(inside, level.cast("int")).otherwise(128)
    near = F.explode(F.array(*(F.struct((at + d).alias("bin"), F.when(inside, w).otherwise(0).alias("w")) for d, w in ((-1, 1), (0, 2), (1, 1)))))
    bins = px.select(*by, near.alias("b")).where("b.bin between 0 and 255").groupBy(*by, F.col("b.bin").alias("bin")).agg(F.sum("b.w").alias("w"))
    return bins.groupBy(*by).agg(F.max_by("bin", F.struct(F.col("w"), F.col("bin") == 128, -F.col("bin"))).cast("double").alias("v"))
