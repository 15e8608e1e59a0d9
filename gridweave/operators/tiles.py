"""Programs over neighbourhoods: pixels are gathered into square tiles, tiles pass on their margins, a program sees arrays.

A pixel is shuffled once, to its tile, and a tile then sends itself and at most eight margins, so the rows shuffled hang on
the number of pixels and tiles and not on the size of the neighbourhood. A program runs once for each tile with its halo.
Where a pixel has no row or a null it isn't known; rows that are there come out again, others don't.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridweave.operators.pixels import KEYS, with_dims

SIDE = 64
#: Planes by name and which of their samples are known, all with the halo; returns a pair of arrays without it for each output.
Program = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]


def _cut(columns: tuple[str, ...], reach: int, side: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a tile become arrays: the tile for itself, its margins for the tiles beside it."""

    def run(rows: pa.Table) -> pa.Table:
        j, i = (rows.column(k).to_numpy() for k in ("j", "i"))
        tj, ti, y, x = int(j[0] // side), int(i[0] // side), j % side, i % side
        planes, known = np.zeros((len(columns), side, side)), np.zeros((len(columns), side, side), np.uint8)
        for k, name in enumerate(columns):
            own = rows.column(name)
            there = own.is_valid().to_numpy()
            planes[k, y[there], x[there]] = own.drop_null().to_numpy()
            known[k, y[there], x[there]] = 1
        here = np.zeros((side, side), np.uint8)
        here[y, x] = rows.column("here").to_numpy(zero_copy_only=False)
        out = []
        ends = {-1: (0, reach, reach + side), 0: (0, side, reach), 1: (side - reach, side, 0)}  # from, to, where it goes
        for dj, (y0, y1, ty) in ends.items():
            for di, (x0, x1, tx) in ends.items():
                part = known[:, y0:y1, x0:x1]
                if dj == di == 0 or part.any():
                    out.append((tj + dj, ti + di, ty, tx, y1 - y0, x1 - x0, planes[:, y0:y1, x0:x1].tobytes(), part.tobytes(), here.tobytes() if dj == di == 0 else None))
        names = ("tj", "ti", "y", "x", "h", "w", "planes", "known", "here")
        kinds = [pa.int32()] * 6 + [pa.binary()] * 3
        first = pa.array(np.zeros(len(out), np.int64))
        keys = {k: rows.column(k).combine_chunks().take(first) for k in ("image_id", "c")}
        return pa.table(keys | {n: pa.array(c, t) for n, c, t in zip(names, zip(*out), kinds)})

    return run


def _put_together(columns: tuple[str, ...], outputs: tuple[str, ...], reach: int, side: int, program: Program, fields: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(parts: pa.Table) -> pa.Table:
        full = side + 2 * reach
        planes, known, here = np.zeros((len(columns), full, full)), np.zeros((len(columns), full, full), bool), None
        for r in parts.drop_columns(["image_id", "c"]).to_pylist():
            place = np.s_[:, r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]
            shape = (len(columns), r["h"], r["w"])
            planes[place], known[place] = np.frombuffer(r["planes"]).reshape(shape), np.frombuffer(r["known"], np.uint8).reshape(shape)
            if r["here"] is not None:
                here = np.frombuffer(r["here"], bool).reshape(side, side)
        if here is None or not here.any():  # only margins of others came, or none but pixels of the surroundings
            return fields.empty_table()
        rows, cols = (np.flatnonzero(here.any(axis)) for axis in (1, 0))
        y0, y1, x0, x1 = rows[0], rows[-1] + 1, cols[0], cols[-1] + 1
        seen = np.s_[y0 : y1 + 2 * reach, x0 : x1 + 2 * reach]
        found = program({n: planes[k][seen] for k, n in enumerate(columns)}, {n: known[k][seen] for k, n in enumerate(columns)})
        y, x = np.nonzero(here[y0:y1, x0:x1])
        tj, ti = parts.column("tj")[0].as_py(), parts.column("ti")[0].as_py()
        first = pa.array(np.zeros(len(y), np.int64))
        out = {k: parts.column(k).combine_chunks().take(first) for k in ("image_id", "c")}
        out |= {"j": pa.array((tj * side + y0 + y).astype(np.int32)), "i": pa.array((ti * side + x0 + x).astype(np.int32))}
        out |= {n: pa.array(np.asarray(v, float)[y, x], mask=~np.asarray(ok, bool)[y, x]) for n, (v, ok) in zip(outputs, found)}
        return pa.table(out).select(fields.names).cast(fields)

    return run


def blocks(px: DataFrame, reach: int, columns: tuple[str, ...], side: int) -> DataFrame:
    """Tiles and their margins, addressed to the tiles that need them."""
    kinds = {k: px.schema[k].dataType.simpleString() for k in ("image_id", "c")}
    cell = lambda k: F.floor(F.col(k) / side).cast("int")
    return px.groupBy("image_id", "c", cell("j").alias("tj"), cell("i").alias("ti")).applyInArrow(_cut(columns, reach, side), f"image_id {kinds['image_id']}, c {kinds['c']}, tj int, ti int, y int, x int, h int, w int, planes binary, known binary, here binary")


def on_tiles(px: DataFrame, reach: int, program: Program, columns: tuple[str, ...] = ("v",), outputs: tuple[str, ...] = ("v",), side: int = SIDE) -> DataFrame:
    """``outputs`` of ``program`` for each pixel of ``px``, with what is known of ``columns`` up to ``reach`` around it.

    Rows with a column ``here`` that is false are surroundings only. Tiles are at least as wide as the reach.
    """
    side = max(side, reach)
    here = F.col("here") if "here" in px.columns else F.lit(True).alias("here")
    own = px.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in columns), here)
    schema = own.select("image_id", "j", "i", "c", *(F.lit(None).cast("double").alias(o) for o in outputs)).schema
    fields = to_arrow_schema(schema)
    out = blocks(own, reach, columns, side).groupBy("image_id", "c", "tj", "ti").applyInArrow(_put_together(columns, outputs, reach, side, program, fields), schema)
    return out.select("image_id", "j", "i", "c", *outputs)


def extended(px: DataFrame, reach: int, boundary: str) -> DataFrame:
    """Adds what a periodic or symmetric image has up to ``reach`` beyond its border, as rows with ``here`` false."""
    if boundary not in ("periodic", "symmetric"):
        raise ValueError(f"unknown boundary {boundary}")

    def copies(k: str, n: str) -> Column:
        period = F.col(n) * (1 if boundary == "periodic" else 2)
        again = lambda at: F.transform(F.sequence(F.ceil((-reach - at) / period), F.floor((F.col(n) - 1 + reach - at) / period)), lambda m: (at + m * period).cast("int"))
        none = F.array().cast("array<int>")
        some = lambda at: F.when(F.ceil((-reach - at) / period) <= F.floor((F.col(n) - 1 + reach - at) / period), again(at)).otherwise(none)
        return some(F.col(k)) if boundary == "periodic" else F.concat(some(F.col(k)), some(2 * F.col(n) - 1 - F.col(k)))

    d = with_dims(px).withColumn("j_", F.explode(copies("j", "h"))).withColumn("i_", F.explode(copies("i", "w")))
    inside = F.col("j_").between(0, F.col("h") - 1) & F.col("i_").between(0, F.col("w") - 1)
    return d.withColumn("here", inside).withColumn("j", F.col("j_")).withColumn("i", F.col("i_")).drop("j_", "i_", "w", "h")


def _along(x: np.ndarray, n: int, axis: int, join: Callable) -> np.ndarray:
    """``join`` over n places in a row, by doubling: log n passes."""
    x = np.moveaxis(x, axis, 0)
    length, have, out = len(x) - n + 1, 1, x
    while have * 2 <= n:
        out = join(out[:-have], out[have:])
        have *= 2
    out = out if have == n else join(out[:length], out[n - have : n - have + length])
    return np.moveaxis(out[:length], 0, axis)


def moved(x: np.ndarray, reach: int, dx: int, dy: int) -> np.ndarray:
    """The view of the inner part at an offset."""
    return x[reach + dy : x.shape[0] - reach + dy, reach + dx : x.shape[1] - reach + dx]


def over(x: np.ndarray, reach: int, offsets: list[tuple[int, int]], join: Callable) -> np.ndarray:
    """``join`` of the samples at the offsets; rectangles go along one axis and then the other."""
    xs, ys = sorted({o[0] for o in offsets}), sorted({o[1] for o in offsets})
    if len(set(offsets)) == (xs[-1] - xs[0] + 1) * (ys[-1] - ys[0] + 1):
        part = x[reach + ys[0] : x.shape[0] - reach + ys[-1], reach + xs[0] : x.shape[1] - reach + xs[-1]]
        return _along(_along(part, ys[-1] - ys[0] + 1, 0, join), xs[-1] - xs[0] + 1, 1, join)
    out = moved(x, reach, *offsets[0])
    for o in offsets[1:]:
        out = join(out, moved(x, reach, *o))
    return out


def reach_of(offsets) -> int:
    return max((max(abs(x), abs(y)) for x, y in offsets), default=0)


def least(v: np.ndarray, known: np.ndarray, reach: int, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Least known sample; one that isn't a number counts only where there is no other."""
    number = known & ~np.isnan(v)
    any_, numbers = (over(m, reach, offsets, np.logical_or) for m in (known, number))
    out = over(np.where(number, v, np.inf), reach, offsets, np.minimum)
    return np.where(numbers, out, np.nan), any_


def greatest(v: np.ndarray, known: np.ndarray, reach: int, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Greatest known sample, where one that isn't a number is above all others."""
    return over(np.where(known, v, -np.inf), reach, offsets, np.maximum), over(known, reach, offsets, np.logical_or)


def middle(v: np.ndarray, known: np.ndarray, reach: int, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Median of the known samples."""
    all_ = np.stack([moved(np.where(known, v, np.inf), reach, *o) for o in offsets])
    n = np.sum([moved(known, reach, *o) for o in offsets], axis=0)
    all_.sort(axis=0)
    at = lambda k: np.take_along_axis(all_, np.clip(k, 0, len(all_) - 1)[None], 0)[0]
    low, high = at((n - 1) // 2), at(n // 2)
    with np.errstate(invalid="ignore"):
        return np.where(low == high, low, (low + high) / 2), n > 0


def _parts(kernel: dict[tuple[int, int], float], reach: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Two one-dimensional kernels of which this one is the product, if there are such."""
    w = np.zeros((2 * reach + 1, 2 * reach + 1))
    for (x, y), k in kernel.items():
        w[y + reach, x + reach] = k
    y, x = np.unravel_index(np.abs(w).argmax(), w.shape)
    down, across = w[:, x], w[y] / w[y, x]
    return (down, across) if np.allclose(np.outer(down, across), w, rtol=1e-12, atol=1e-15 * abs(w[y, x])) else None


def weighted(x: np.ndarray, kernel: dict[tuple[int, int], float], reach: int) -> np.ndarray:
    """Sum of the samples around each, by weights at their offsets: along both axes where the kernel is a product, by Fourier transforms where it is large."""
    two = _parts(kernel, reach) if reach else None
    if two is not None:
        rows = sum(k * x[d : x.shape[0] - 2 * reach + d] for d, k in enumerate(two[0]) if k)
        return sum(k * rows[:, d : x.shape[1] - 2 * reach + d] for d, k in enumerate(two[1]) if k)
    if len(kernel) > 400 and np.isfinite(x).all():
        shape = x.shape
        w = np.zeros(shape)
        for (dx, dy), k in kernel.items():
            w[-dy % shape[0], -dx % shape[1]] += k
        whole = np.fft.irfft2(np.fft.rfft2(x) * np.fft.rfft2(w), shape)
        return whole[reach : shape[0] - reach, reach : shape[1] - reach]
    return sum(k * moved(x, reach, *o) for o, k in kernel.items())
