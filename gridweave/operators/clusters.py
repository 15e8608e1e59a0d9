"""Clusters of the samples of each cell of a stack: k-means and k-medians in one dimension, and modes against chance.

All three work on counted values: the samples of a cell are counted by steps of a grid before and while they are shuffled,
so what one task holds of a cell is its counts, range / step of them, however many samples the cell has. Clusters are then
found for many cells in one call over arrays.

Nulls and samples that aren't finite don't count; a cell without others gives no row. Results are pixels: channel 0 has
the number of clusters, channels 1 and on their centres in rising order, null up to ``most``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(px: DataFrame, step: float, by: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """v, n: samples of each cell by the nearest multiple of ``step``; 0 counts equal values."""
    own = px.where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    return own.groupBy(*by, (F.col("v") if step == 0 else F.floor(F.col("v") / step + 0.5) * step).cast("double").alias("v")).agg(F.count("*").alias("n"))


def bins(px: DataFrame, width: float, by: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """Histogram of each cell in bins of ``width`` from its least sample on: lo, bin, n, total, and on_edge, how many stand exactly on the bin's lower end."""
    own = px.where(F.col("v").isNotNull() & (F.abs("v") < float("inf"))).select(*by, F.col("v").cast("double").alias("v"))
    d = own.join(own.groupBy(*by).agg(F.min("v").alias("lo")), list(by)).withColumn("bin", F.floor((F.col("v") - F.col("lo")) / width).cast("int"))
    return d.groupBy(*by, "lo", "bin").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.count_if(F.col("v") == F.col("lo") + width * F.col("bin")).alias("on_edge"))


def weighted_clusters(v: np.ndarray, n: np.ndarray, k: int, medians: bool) -> np.ndarray:
    """First places of the k runs of sorted values whose sum of squared differences to the mean, or of absolute ones to the median, is least.

    Dynamic programming over the values with the weights n; of equal sums the one whose last run begins first.
    """
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * v, n * v * v))
    a, b = np.meshgrid(np.arange(len(v)), np.arange(1, len(v) + 1), indexing="ij")
    size = np.where(b > a, w[b] - w[a], 1.0)
    if medians:
        middle = np.searchsorted(w[1:], w[a] + size / 2)  # the lower median, as each between both costs as much
        middle = np.minimum(middle, len(v) - 1)
        cost = v[middle] * (w[middle] - w[a]) - (s[middle] - s[a]) + (s[b] - s[middle]) - v[middle] * (w[b] - w[middle])
    else:
        cost = q[b] - q[a] - (s[b] - s[a]) ** 2 / size
    cost = np.where(b > a, np.maximum(cost, 0.0), np.inf)  # of the values a to b - 1
    best, starts = cost[0], []
    for _ in range(1, k):
        ahead = np.concatenate([[np.inf], best[:-1]])[:, None] + cost  # the last run begins at a
        starts.append(ahead.argmin(0))
        best = ahead.min(0)
    cuts, end = [], len(v)
    for begin in reversed(starts):
        cuts.append(int(begin[end - 1]))
        end = cuts[-1]
    return np.array([0, *reversed(cuts)])


def _at(v: np.ndarray, n: np.ndarray, rank: int) -> float:
    return v[np.searchsorted(np.cumsum(n), rank, "right")]


def _spread(v: np.ndarray, n: np.ndarray) -> float:
    """Interquartile difference by the means of two places each."""
    size = int(n.sum())
    place = lambda k: min(max(k, 0), size - 1)
    at = lambda q: (_at(v, n, place((q * size + 1) // 4 - 1)) + _at(v, n, place(q * size // 4))) / 2
    return at(3) - at(1)


def find_clusters(v: np.ndarray, n: np.ndarray, kind: str, precision: float, most: int) -> list[float]:
    """Centres with the least k whose clusters have, in the mean, a variance below precision^2 (kmeans) or an interquartile difference below it (kmedians)."""
    centres: list[float] = []
    for k in range(1, min(most, len(v)) + 1):
        first = weighted_clusters(v, n, k, kind == "kmedians")
        runs = [(v[a:b], n[a:b]) for a, b in zip(first, [*first[1:], len(v)])]
        if kind == "kmeans":
            centres = [float(np.average(x, weights=c)) for x, c in runs]
            if np.mean([np.average((x - m) ** 2, weights=c) for (x, c), m in zip(runs, centres)]) < precision**2:
                break
        else:
            centres = [float((_at(x, c, (int(c.sum()) + 1) // 2 - 1) + _at(x, c, int(c.sum()) // 2)) / 2) for x, c in runs]
            if np.mean([_spread(x, c) for x, c in runs]) < precision:
                break
    return centres


def relative_entropy(r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of a share r of the samples where p was to be expected; 0 for all bins together."""
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x, y: np.where(x > 0, x * np.log(x / y), 0.0)
        return np.where(p >= 1, 0.0, part(r, p) + part(1 - r, 1 - p))


def modes(counts: np.ndarray, epsilon: float) -> list[tuple[int, int, float]]:
    """First and last bin, and expected number of false alarms, of the maximal meaningful modes of a histogram, in rising order.

    An interval is meaningful if by the large-deviation bound of the binomial tail fewer than ``epsilon`` intervals of
    uniform samples would be as far from their share; it is a gap if it has less than that. A mode has no gap in it, none
    within it is more meaningful, and none around it is as meaningful.
    """
    size, n = len(counts), int(counts.sum())
    upto = np.concatenate([[0], np.cumsum(counts)])
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    inside = b >= a
    r, p = np.where(inside, (upto[b + 1] - upto[a]) / n, 0.0), np.where(inside, (b - a + 1) / size, 1.0)
    e = relative_entropy(r, p)
    strong = inside & (e >= np.log(size * (size + 1) / (2 * epsilon)) / n)
    gap = strong & (r < p)
    gap = np.logical_or.accumulate(np.logical_or.accumulate(gap[::-1], 0)[::-1], 1)  # in it or within
    good = strong & (r >= p) & ~gap
    s = np.where(good, e, -np.inf)
    within = np.maximum.accumulate(np.maximum.accumulate(s[::-1], 0)[::-1], 1)
    around = np.maximum.accumulate(np.maximum.accumulate(s, 0)[:, ::-1], 1)[:, ::-1]
    no = np.full(size, -np.inf)
    smaller = np.maximum(np.vstack([within[1:], no]), np.column_stack([no, within[:, :-1]]))
    larger = np.maximum(np.vstack([no, around[:-1]]), np.column_stack([around[:, 1:], no]))
    keep = good & (smaller <= e) & (larger < e)
    return [(int(x), int(y), float(size * (size + 1) / 2 * np.exp(-n * e[x, y]))) for x, y in np.argwhere(keep)]


def _arrays(rows: DataFrame, by: tuple[str, ...], columns: list[str], order: str, extra: list[str]) -> DataFrame:
    """One row for each cell with its counts as arrays, in order."""
    sorted_ = F.sort_array(F.collect_list(F.struct(order, *(c for c in columns if c != order))))  # counts, range / step of them
    d = rows.groupBy(*by, *extra).agg(sorted_.alias("s"))
    return d.select(*by, *extra, *(F.col(f"s.{c}").alias(c) for c in columns))


def _per_cell(rows: DataFrame, by: tuple[str, ...], fn: Callable[[pd.Series], list[float]], most: int) -> DataFrame:
    """Centres by ``fn`` of the arrays of each cell, as pixels."""
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            out = d[list(by)].copy()
            out["x"] = [[float(len(c)), *c, *[None] * (most - len(c))] for c in (fn(r) for r in d.itertuples(index=False))]
            yield out

    found = rows.mapInPandas(run, f"{fields}, x array<double>")
    return found.select(*by, F.posexplode("x").alias("c", "v"))


def cluster(px: DataFrame, kind: str, precision: float, most: int = 7, step: float = 0.0, by: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """Clusters of each cell by kmeans, kmedians or contrario: j, i, c, v.

    For k-means and k-medians ``precision`` bounds the spread of a cluster and samples are counted by multiples of ``step``
    (0: as they are, for cells of few different values); for contrario it is the number of false alarms to be expected
    and ``step`` the width of a bin (0: 5).
    """
    if kind == "contrario":
        width = step or 5.0

        def centres(r) -> list[float]:
            at, n, total, edge = (np.asarray(x) for x in (r.bin, r.n, r.total, r.on_edge))
            full = np.zeros((3, int(at.max()) + 2))
            full[:, at] = n, total, edge
            out = []
            for a, b, _ in modes(full[0, :-1].astype(np.int64), precision)[:most]:
                on_end = full[2, b + 1]  # samples on the upper end count too
                out.append(float((full[1, a : b + 1].sum() + on_end * (r.lo + width * (b + 1))) / (full[0, a : b + 1].sum() + on_end)))
            return out

        return _per_cell(_arrays(bins(px, width, by), by, ["bin", "n", "total", "on_edge"], "bin", ["lo"]), by, centres, most)
    if kind not in ("kmeans", "kmedians"):
        raise ValueError(f"unknown clusters {kind}")
    rows = _arrays(counted(px, step, by), by, ["v", "n"], "v", [])
    return _per_cell(rows, by, lambda r: find_clusters(np.asarray(r.v, float), np.asarray(r.n, float), kind, precision, most), most)
