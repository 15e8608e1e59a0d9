"""Exact order statistics of groups of any size.

Equal values of a group are counted before anything is shuffled, counted values are dealt by ranges of group and value, and
each range knows how many samples of its group go before it, so that a rank is picked inside one range. A cell with a
large share of all samples is spread over many tasks; partial counts merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.storage import running


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def order_statistics(px: DataFrame, places: dict[str, Callable[[Column], Column]], by: tuple[str, ...]) -> DataFrame:
    """For each group a column for each of ``places``: the value at the 0-based rank that the function gives for the number of samples. Nulls don't count."""
    counts = px.where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    ranked = running(counts, list(by), ["v"], "n", "cum_", total="all_")
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("cum_") > place(F.col("all_")), F.col("v"))).alias(name) for name, place in places.items()))


def places_of(op: str) -> dict[str, Callable[[Column], Column]] | None:
    """Ranks that an accumulator needs, by a suffix; null where it isn't one of order."""
    if op == "med":
        return {"": lambda n: F.floor((n - (n == 2).cast("int")) / 2)}
    if op == "medv":
        return {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}
    if op == "iqd":  # of three samples the range
        return {"low": lambda n: F.when(n == 3, 0).otherwise(half_up((n - 1) * 0.25)), "high": lambda n: F.when(n == 3, 2).otherwise(half_up((n - 1) * 0.75))}
    if op[0] == "q":
        return {"": lambda n: half_up((n - 1) * float(op[1:]) / 100)}
    return None


def accumulated(px: DataFrame, ops: list[str], by: tuple[str, ...]) -> DataFrame:
    """A column for each of the accumulators med, medv, iqd and q{percent} of each cell."""
    own = {op: places_of(op) for op in ops}
    found = order_statistics(px, {f"{k}_{s}": place for k, op in enumerate(ops) for s, place in own[op].items()}, by)
    out = {"med": lambda k: F.col(f"{k}_"), "medv": lambda k: (F.col(f"{k}_low") + F.col(f"{k}_high")) / 2, "iqd": lambda k: F.col(f"{k}_high") - F.col(f"{k}_low")}
    return found.select(*by, *(out.get(op, out["med"])(k).alias(op) for k, op in enumerate(ops)))
