"""Rows of two tables that share a key, compared in blocks of bounded size by matrix products.

Squares of distances come from one product together with a bound of its rounding; what the bound leaves open is decided
by sums in the order of the components, so results don't hang on how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.storage import materialise

#: Rows of one side in a block; pairs looked at at once; rows of a tile, where windows have fewer.
BLOCK, PAIRS, FEW = 8192, 1 << 19, 500


def meet(a: DataFrame, b: DataFrame, key: list[str], fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, times: int = 1) -> DataFrame:
    """What ``fn`` makes of rows of a and b with an equal ``key``, of all pairs of their blocks; rows are dealt to blocks by ``id``. A block has up to ``times`` BLOCK rows; in larger ones each row has fewer copies."""
    count = lambda d, n: d.groupBy(*key).agg(F.ceil(F.count("*") / (BLOCK * times)).cast("int").alias(n))
    blocks = materialise(count(a, "na").join(count(b, "nb"), key))  # keys of both sides only
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(blocks, key).withColumn("p", deal("na")).withColumn("q", every("nb")).drop("na", "nb")
    right = b.join(blocks, key).withColumn("q", deal("nb")).withColumn("p", every("na")).drop("na", "nb")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, where both sides are one table
    empty = pa.schema([]).empty_table()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return fn(x, y) if x.num_rows and y.num_rows else empty

    return left.groupBy(*key, "p", "q").cogroup(right.groupBy(*key, "p", "q")).applyInArrow(run, schema)


def usable(d: DataFrame, *numbers: str) -> DataFrame:
    """Rows with a descriptor of finite numbers and finite ``numbers``; all others are near nothing."""
    finite = lambda x: F.abs(x.cast("double")) < float("inf")
    return d.where(F.forall("descr", finite)).where(" and ".join(["true", *(f"abs(cast({k} as double)) < double('infinity')" for k in numbers)]))


def tiled(a: DataFrame, b: DataFrame, rx: float, ry: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both with the key under which a row of a meets all of b within rx, ry: a in its own tile, b in those around.

    A tile is one window wide, or so many that its rows are a few hundred on average.
    """
    own, other = (usable(d, "x", "y").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "descr") for d in (a, b))
    at = lambda k, side: F.floor(F.col(k) / side)
    widths = [4**k for k in range(11)]
    have = own.agg(F.count("*").alias("n"), *(F.approx_count_distinct(F.xxhash64(at("x", rx * w), at("y", ry * w))).alias(f"w{w}") for w in widths)).first()
    w = next((w for w in widths if have.n >= FEW * have[f"w{w}"]), widths[-1])
    around = lambda k, r: F.explode(F.sequence(F.floor((F.col(k) - 1.000001 * r) / (r * w)), F.floor((F.col(k) + 1.000001 * r) / (r * w))))
    own = own.withColumns({"ci": at("x", rx * w), "cj": at("y", ry * w), "dims": F.size("descr")})
    return own, other.withColumn("ci", around("x", rx)).withColumn("cj", around("y", ry)).withColumn("dims", F.size("descr")), ["ci", "cj", "dims"]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows."""
    return pc.list_flatten(column).to_numpy().astype(float).reshape(len(column), -1)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[k].to_numpy().astype(float) for k in names]


def distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Those of rows of u from rows of v (shapes that go together but for the last axis), summed in the order of the components."""
    s = np.zeros(np.broadcast_shapes(u.shape, v.shape)[:-1])
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(u.shape[-1]):
            gap = u[..., k] - v[..., k]
            s += gap * gap
    return np.sqrt(s)


def _products(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """What squares of distances are made of, and how far they may be off; where they overflow nothing, so that all pairs are left open."""
    with np.errstate(over="ignore", invalid="ignore"):
        nu, nv = (u * u).sum(1), (v * v).sum(1)
        off = 1e-15 * (u.shape[1] + 16) * (nu.max() + nv.max())
    if off < np.inf:
        return u, v, nu, nv, off
    return u[:, :0], v[:, :0], np.zeros(len(u)), np.zeros(len(v)), 0.0


def _exact(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = 1 << 15
    return np.concatenate([distances(u[i[k : k + step]], v[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0)])


def nearest(may: Callable[[pa.Table, pa.Table], Callable[[slice], np.ndarray]], t: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For ``meet``: from, to, d of the nearest row closer than ``t`` of those that ``may`` be, ties to the lower id. ``may`` gives for a slice of the first table's rows a mask over both."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.take(pc.sort_indices(y["id"], null_placement="at_start"))
        u, v, allowed = matrix(x["descr"]), matrix(y["descr"]), may(x, y)
        pu, pv, nu, nv, off = _products(u, v)
        double, step, found = 2 * pv.T, max(1, PAIRS // len(v)), []
        for k in range(0, len(u), step):
            part = slice(k, k + step)
            s = nv - pu[part] @ double
            s[~allowed(part)] = np.inf
            low = s.min(1)
            low[~(low < t * t - nu[part] + off)] = -np.inf
            i, j = np.nonzero(s <= (low + 2 * off)[:, None])
            i += k
            d = _exact(u, v, i, j)
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            best = (np.diff(i, prepend=-1) > 0) & (d < t)
            found.append((i[best], j[best], d[best]))
        i, j, d = (np.concatenate(f) for f in zip(*found))
        return pa.table({"from": x["id"].take(i), "to": y["id"].take(j), "d": d})

    return run


def close(u: np.ndarray, v: np.ndarray, p: list[np.ndarray], q: list[np.ndarray], dp: float, dd: float):
    """Index pairs of rows closer than ``dd`` in u, v and ``dp`` in the positions p, q (x and y of each), some at a time."""
    pu, pv, nu, nv, off = _products(u, v)
    double, step = 2 * pv.T, max(1, PAIRS // len(v))
    for k in range(0, len(u), step):
        part = slice(k, k + step)
        x, y = p[0][part, None] - q[0], p[1][part, None] - q[1]
        i, j = np.nonzero((nv - pu[part] @ double < (dd * dd - nu[part] + off)[:, None]) & (np.abs(x) < dp) & (np.abs(y) < dp))
        near = np.hypot(x[i, j], y[i, j]) < dp
        i, j = i[near] + k, j[near]
        near = _exact(u, v, i, j) < dd
        yield i[near], j[near]
