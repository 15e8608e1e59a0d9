"""Matching of descriptors without a window, removal of near copies, models by random samples, and user code.

All pairs are needed by definition for exact nearest descriptors. They are formed in blocks: both sides are dealt into
blocks by hash, each pair of blocks is one group of bounded size, and only the best of each block pair leaves it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators.blocks import close, matrix, meet, nearest, numbers, tiled, usable
from gridweave.storage import discard, materialise

#: Rows of one side in a block; sectors of directions that have epipolar lines; pairs of keypoints compared before some are decided.
BLOCK, SECTORS, MOST_PAIRS = 2000, 32, 1 << 26


def _blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides at all pairs of their blocks; keypoints without a descriptor, or with a null in it, match nothing."""
    a, b = (d.where(F.col("descr").isNotNull() & F.forall("descr", lambda x: x.isNotNull())) for d in (a, b))
    na, nb = (max(1, -(-d.count() // BLOCK)) for d in (a, b))
    deal = lambda d, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")  # noqa: E731, ARG005
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.select("id", "descr").withColumn("p", deal(a, na)).withColumn("q", every(nb))
    other = b.select(F.col("id").alias("id"), F.col("descr").alias("descr"))  # columns of its own, where both sides are one table
    return left, other.withColumn("q", deal(b, nb)).withColumn("p", every(na))


def _distances(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    u, v = np.stack(x["descr"].to_numpy()).astype(float), np.stack(y["descr"].to_numpy()).astype(float)
    return np.sqrt(np.maximum(((u[:, None, :] - v[None, :, :]) ** 2).sum(2), 0)) if len(u) * len(v) * u.shape[1] < 1 << 24 else np.stack([np.sqrt(((v - w) ** 2).sum(1)) for w in u])


def match_nearest(a: DataFrame, b: DataFrame, t: float, top: float | None = None, k: int = 1) -> DataFrame:
    """For each keypoint of a its k nearest descriptors of b that are closer than ``t``: from, to, d, nth. Distances count as at most ``top``."""
    left, right = _blocks(a, b)

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"from": [], "to": [], "d": []}).astype({"from": "int64", "to": "int64", "d": float})
        x, y = x.sort_values("id"), y.sort_values("id")
        d = _distances(x, y)
        if top is not None:
            d = np.minimum(d, top)
        near = np.argsort(d, 1, kind="stable")[:, :k]
        out = pd.DataFrame({"from": np.repeat(x["id"].to_numpy(), near.shape[1]), "to": y["id"].to_numpy()[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel()})
        return out[out["d"] < t]

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(best, "`from` bigint, `to` bigint, d double")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("from").orderBy("d", "to"))).where(F.col("nth") <= k)


def match_all(a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """Every pair of keypoints closer than ``t``: from, to, d."""
    left, right = _blocks(a, b)

    def close(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"from": [], "to": [], "d": []}).astype({"from": "int64", "to": "int64", "d": float})
        d = _distances(x, y)
        i, j = np.nonzero(d < t)
        return pd.DataFrame({"from": x["id"].to_numpy()[i], "to": y["id"].to_numpy()[j], "d": d[i, j]})

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(close, "`from` bigint, `to` bigint, d double")


def match_epipolar(a: DataFrame, b: DataFrame, matrix: list[float], t: float, eps: float) -> DataFrame:
    """For each keypoint of a the nearest descriptor of b within eps/2 of its epipolar line and closer than ``t``: from, to, d.

    Lines alike in direction and in distance from the middle of b make a bundle. A keypoint of a goes to its line's
    bundle, one of b to all bundles that have room for a line near it; there they are compared in blocks.
    """
    b = usable(b, "x", "y").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "descr", F.size("descr").alias("dims"))
    box = b.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, x1, y0, y1 = (0.0 if v is None else v for v in box)
    cx, cy, reach = (x0 + x1) / 2, (y0 + y1) / 2, math.hypot(x1 - x0, y1 - y0) / 2
    m = [F.lit(float(k)) for k in matrix]
    own = a.select("id", "descr", F.size("descr").alias("dims"), *((m[3 * k] * F.col("x") + m[3 * k + 1] * F.col("y") + m[3 * k + 2]).alias(n) for k, n in enumerate(("la", "lb", "lc"))))
    own = usable(own.where("la != 0 or lb != 0"), "la", "lb", "lc")
    turn = F.atan2("lb", "la")
    own = own.withColumn("turn", F.when(turn < 0, turn + math.pi).when(turn >= math.pi, turn - math.pi).otherwise(turn))
    ahead = F.when((F.col("lb") > 0) | ((F.col("lb") == 0) & (F.col("la") > 0)), 1.0).otherwise(-1.0)
    own = own.withColumn("off", ahead * (F.col("la") * cx + F.col("lb") * cy + F.col("lc")) / F.hypot("la", "lb")).where(F.abs("off") <= reach + eps)
    sector = lambda n: F.floor(F.col("turn") * n / math.pi).cast("int")
    finest = max(1, math.ceil(math.pi * reach / eps))
    parts = sorted({min(n, finest) for n in (16, 64, 256, 1024, 4096)})
    held = own.agg(*(F.approx_count_distinct(sector(n)).alias(f"n{n}") for n in parts)).first()
    n = max([k for k in parts if held[f"n{k}"] <= SECTORS], default=parts[0])  # as fine as few sectors have lines
    wide = max(eps, reach / 256)
    own = own.withColumns({"s": sector(n), "o": F.floor(F.col("off") / wide)}).drop("turn", "off")
    used = sorted(r.s for r in own.select("s").distinct().collect())
    if not used:
        return own.select(F.col("id").alias("from"), F.col("id").alias("to"), F.lit(0.0).alias("d")).limit(0)
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("s"), F.lit(math.cos((k + 0.5) * math.pi / n)).alias("u"), F.lit(math.sin((k + 0.5) * math.pi / n)).alias("v")) for k in used)))
    far = F.hypot(F.col("x") - cx, F.col("y") - cy)
    other = b.withColumn("at", at).withColumn("mid", -((F.col("x") - cx) * F.col("at.u") + (F.col("y") - cy) * F.col("at.v"))).withColumn("room", 1.000001 * (eps / 2 + far * math.pi / (2 * n)) + 1e-12 * reach)
    other = other.withColumn("o", F.explode(F.sequence(F.floor((F.col("mid") - F.col("room")) / wide), F.floor((F.col("mid") + F.col("room")) / wide))))
    other = other.select("id", "x", "y", "descr", "dims", F.col("at.s").alias("s"), "o")

    def along(lines, points):
        (la, lb, lc), (x, y) = numbers(lines, "la", "lb", "lc"), numbers(points, "x", "y")
        return lambda part: np.abs(la[part, None] * x + lb[part, None] * y + lc[part, None]) / np.hypot(la, lb)[part, None] <= eps / 2

    kind = lambda d: d.schema["id"].dataType.simpleString()
    found = meet(own, other, ["s", "o", "dims"], nearest(along, t), f"`from` {kind(own)}, `to` {kind(b)}, d double")
    return found.groupBy("from").agg(F.min(F.struct("d", "to")).alias("m")).select("from", "m.to", "m.d")


def _near(a: DataFrame, b: DataFrame, dp: float, dd: float, pairs: bool) -> DataFrame:
    """Rows of a and b closer than ``dp`` in position and ``dd`` in descriptor: their ids a < b, or ids of those of a that are near any."""
    own, other, key = tiled(a, b, dp, dp)
    kind = own.schema["id"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        met = close(matrix(x["descr"]), matrix(y["descr"]), numbers(x, "x", "y"), numbers(y, "x", "y"), dp, dd)
        if not pairs:
            return pa.table({"id": x["id"].take(np.unique(np.concatenate([i for i, _ in met])))})
        found = [pa.table({"a": x["id"].take(i), "b": y["id"].take(j)}) for i, j in met]
        both = pa.concat_tables(found)
        return both.filter(pc.less(both["a"], both["b"]))

    return meet(own, other, key, run, f"a {kind}, b {kind}" if pairs else f"id {kind}").distinct()


def near_keypoints(points: DataFrame, dp: float, dd: float) -> DataFrame:
    """Pairs a < b of ids closer than ``dp`` in position and ``dd`` in descriptor, compared in blocks of tiles at least dp wide."""
    points = points.where("id is not null")
    return _near(points, points, dp, dd, True)


def _load(points: DataFrame, dp: float) -> int:
    """Pairs that ``near_keypoints`` compares."""
    own, other, key = tiled(points, points, dp, dp)
    met = own.groupBy(*key).agg(F.count("*").alias("n")).join(other.groupBy(*key).agg(F.count("*").alias("m")), key)
    return met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _lost(edges: DataFrame) -> list[DataFrame]:
    """Tables of the ids that go, by decisions along the pairs a < b from the highest id down.

    In rounds: an undecided point without an undecided near one of higher id is kept, and all near it go. Each round is
    a few joins over the pairs that are left; as many rounds as the longest chain of such decisions.
    """
    gone, used = [], []
    while not edges.isEmpty():
        beaten = edges.select(F.col("a").alias("id")).distinct()
        kept = edges.select(F.col("b").alias("id")).distinct().join(beaten, "id", "left_anti")
        lost = materialise(edges.join(kept, edges["b"] == kept["id"], "left_semi").select(F.col("a").alias("id")).distinct())
        gone.append(lost)
        used.append(edges)
        edges = materialise(edges.join(lost, edges["a"] == lost["id"], "left_anti").join(lost, F.col("b") == lost["id"], "left_anti").join(kept, F.col("b") == kept["id"], "left_anti"))
    discard(edges, *used)
    return gone


def _highest(points: DataFrame, dp: float) -> tuple[DataFrame, object]:
    """Points of the highest ids, few enough for their pairs to be written, and the least of those ids; None if that is all of them."""
    top, least = points, None
    while (load := _load(top, dp)) > MOST_PAIRS:
        drawn = sorted((r.id for r in top.select("id").orderBy(F.xxhash64("id"), "id").limit(1000).collect()), reverse=True)  # only where to part them
        at = drawn[min(int(math.sqrt(MOST_PAIRS / load) * len(drawn)), len(drawn) - 1)]
        if at == least or at == drawn[-1] == drawn[0]:
            break  # one id alone
        least = at
        top = points.where(F.col("id") >= F.lit(least))
    return top, least


def dedup_keypoints(points: DataFrame, dp: float, dd: float) -> DataFrame:
    """Keypoints but those that a kept one of higher id is near to: ids from the highest down, each kept unless one kept before is closer than ``dp`` and ``dd``.

    Those of the highest ids, of a bounded number of pairs, are decided first; all that are near those kept go at once,
    and so on with the rest. So pairs among those that go aren't made, but for some. Points without a descriptor, and those of no pair, stay.
    """
    rest, gone, made = usable(points, "x", "y").where("id is not null").select("id", "x", "y", "descr"), [], []
    while True:
        top, least = _highest(rest, dp)
        gone += (lost := _lost(materialise(near_keypoints(top, dp, dd))))
        if least is None:
            break
        below = rest.where(F.col("id") < F.lit(least))
        kept = top
        for some in lost:
            kept = kept.join(some, "id", "left_anti")
        kept = materialise(kept)
        gone.append(beaten := materialise(_near(below, kept, dp, dd, False)))
        made += [kept, rest] if made else [kept]
        rest = materialise(below.join(beaten, "id", "left_anti"))
    discard(*made, *([rest] if made else []))
    return points.join(functools.reduce(DataFrame.unionByName, gone), "id", "left_anti") if gone else points


Fit = Callable[[np.ndarray], "np.ndarray | list[np.ndarray] | None"]
Residual = Callable[[np.ndarray, np.ndarray], np.ndarray]


def ransac(points: DataFrame, columns: list[str], fit: Fit, residual: Residual, size: int, trials: int, error: float, seed: int = 1, least: int = 0, accept: Callable[[np.ndarray], bool] | None = None) -> tuple[np.ndarray | None, int]:
    """The model of ``trials`` minimal samples that most points are within ``error`` of, and their number; none if those are fewer than ``least``.

    A sample may give several models; ``accept`` says which are worth counting.

    ``fit`` makes a model of ``size`` rows of ``columns``, or None; ``residual`` gives each row's distance from a model. The
    samples come from size * trials rows drawn by hash, which reach the driver with the models; points are only counted where they lie.
    """
    drawn = points.select(*columns).orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(size * trials).collect()  # a sampling operator
    rows = np.array([tuple(r) for r in drawn], float).reshape(-1, len(columns))
    rng = np.random.default_rng(seed)
    made = [fit(rows[rng.choice(len(rows), size, replace=False)]) for _ in range(trials)] if len(rows) >= size else []
    models = [m for some in made if some is not None for m in (some if isinstance(some, list) else [some]) if accept is None or accept(m)]
    if not models:
        return None, 0

    def count(frames):
        held = np.zeros(len(models), np.int64)
        for frame in frames:
            x = frame.to_numpy(float)
            held += [int((residual(m, x) <= error).sum()) for m in models]
        yield pd.DataFrame({"model": np.arange(len(models)), "n": held})

    counts = points.select(*columns).mapInPandas(count, "model int, n bigint").groupBy("model").agg(F.sum("n").alias("n"))
    best = counts.orderBy(F.desc("n"), "model").first()
    return (models[best.model], best.n) if best.n >= least else (None, best.n)


def inliers(points: DataFrame, columns: list[str], model: np.ndarray, residual: Residual, error: float) -> DataFrame:
    """``points`` with their residual under the model, those within ``error``."""

    @F.pandas_udf("double")
    def far(*x: pd.Series) -> pd.Series:
        return pd.Series(residual(model, np.column_stack([c.to_numpy(float) for c in x])))

    return points.withColumn("residual", far(*columns)).where(F.col("residual") <= error)


def line_fit(rows: np.ndarray) -> np.ndarray | None:
    """a, b, c of the line a x + b y + c = 0 with unit normal through two rows x, y."""
    (x1, y1), (x2, y2) = rows
    n = np.hypot(x2 - x1, y2 - y1)
    return np.array([y2 - y1, x1 - x2, x2 * y1 - x1 * y2]) / n if n > 0 else None


def line_residual(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.abs(rows @ model[:2] + model[2])


def ransac_line(points: DataFrame, trials: int, error: float, seed: int = 1) -> DataFrame:
    """The line a x + b y + c = 0 (unit normal) through two of the points that most points are within ``error`` of: a, b, c, inliers."""
    model, n = ransac(points, ["x", "y"], line_fit, line_residual, 2, trials, error, seed)
    return points.sparkSession.createDataFrame([] if model is None else [(*map(float, model), int(n))], "a double, b double, c double, inliers bigint")


def affine_fit(rows: np.ndarray) -> np.ndarray | None:
    """The 2x3 matrix that takes x1, y1 to x2, y2, from three rows x1, y1, x2, y2."""
    a = np.column_stack([rows[:, :2], np.ones(len(rows))])
    return np.linalg.solve(a, rows[:, 2:]).T if abs(np.linalg.det(a)) > 1e-9 else None


def affine_residual(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.hypot(*(rows[:, :2] @ model[:, :2].T + model[:, 2] - rows[:, 2:]).T)


def affine_is_sound(model: np.ndarray) -> bool:
    """An affine map that keeps the orientation and neither crushes nor blows up."""
    m = model[:, :2]
    return 0.01 <= np.linalg.det(m) <= 100 and 0.1 <= (m * m).sum() <= 10


def _moderate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved and scaled to mean 0 and mean distance sqrt 2, and the matrix that does so."""
    c = x.mean(0)
    s = np.sqrt(2) / max(np.hypot(*(x - c).T).mean(), 1e-300)
    t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
    return (x - c) * s, t


def _null_space(a: np.ndarray, n: int) -> np.ndarray | None:
    """The last n right singular vectors, if the rest of ``a`` has full rank."""
    _, s, vt = np.linalg.svd(a)
    rank = a.shape[1] - n
    return vt[rank:] if len(s) >= rank and s[rank - 1] > 1e-9 * s[0] else None


def homography_fit(rows: np.ndarray) -> np.ndarray | None:
    """The 3x3 matrix, of norm 1, that takes x1, y1 to x2, y2 in four rows or more: the null space of two equations a row."""
    (p, tp), (q, tq) = _moderate(rows[:, :2]), _moderate(rows[:, 2:])
    one, zero = np.column_stack([p, np.ones(len(p))]), np.zeros((len(p), 3))
    a = np.vstack([np.hstack([one, zero, -one * q[:, :1]]), np.hstack([zero, one, -one * q[:, 1:]])])
    h = _null_space(a, 1)
    if h is None:
        return None
    m = np.linalg.inv(tq) @ h[0].reshape(3, 3) @ tp
    m = m / np.linalg.norm(m)
    return m if abs(np.linalg.det(m)) > 1e-12 else None


def homography_residual(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distance of x2, y2 from where x1, y1 goes; infinite on the line that has no image."""
    z = np.column_stack([rows[:, :2], np.ones(len(rows))]) @ model.T
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.hypot(z[:, 0] / z[:, 2] - rows[:, 2], z[:, 1] / z[:, 2] - rows[:, 3])
    return np.where(np.isfinite(d), d, np.inf)


def fundamental_fit(rows: np.ndarray) -> list[np.ndarray] | None:
    """Matrices F of rank 2 and norm 1 with (x2, y2, 1) F (x1, y1, 1) = 0.

    Seven rows leave a pencil of matrices, of which those with determinant 0 are one or three; of eight or more the
    nearest of rank 2 to the null vector is taken.
    """
    (p, tp), (q, tq) = _moderate(rows[:, :2]), _moderate(rows[:, 2:])
    p1, q1 = (np.column_stack([x, np.ones(len(x))]) for x in (p, q))
    a = (q1[:, :, None] * p1[:, None, :]).reshape(len(rows), 9)
    space = _null_space(a, 2 if len(rows) == 7 else 1)
    if space is None:
        return None
    if len(rows) == 7:
        f, g = (v.reshape(3, 3) for v in space)
        at = np.array([-1.0, 0.0, 1.0, 2.0])  # the determinant of t f + (1 - t) g is a cubic in t
        cubic = np.polyfit(at, [np.linalg.det(t * f + (1 - t) * g) for t in at], 3)
        found = [t.real * f + (1 - t.real) * g for t in np.roots(cubic) if abs(t.imag) < 1e-9]
    else:
        found = [space[0].reshape(3, 3)]
    out = []
    for m in found:
        u, s, vt = np.linalg.svd(m)
        m = tq.T @ (u @ np.diag([s[0], s[1], 0.0]) @ vt) @ tp
        out.append(m / np.linalg.norm(m))
    return out


def epipolar_residual(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distance of x2, y2 from the line of x1, y1."""
    lines = np.column_stack([rows[:, :2], np.ones(len(rows))]) @ model.T
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.abs((lines[:, :2] * rows[:, 2:]).sum(1) + lines[:, 2]) / np.hypot(lines[:, 0], lines[:, 1])
    return np.where(np.isfinite(d), d, np.inf)


def map_tiles(px: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], side: int, halo: int) -> DataFrame:
    """``fn`` gets each tile of ``side`` pixels with ``halo`` more around it (rows image_id, j, i, c, v) and returns rows alike; those of the tile itself are kept."""
    kind = px.schema["image_id"].dataType.simpleString()
    around = lambda k: F.explode(F.sequence(F.floor((F.col(k) - halo) / side), F.floor((F.col(k) + halo) / side)))
    sent = px.select("image_id", "j", "i", "c", F.col("v").cast("double").alias("v")).withColumn("tj", around("j")).withColumn("ti", around("i"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = fn(rows[["image_id", "j", "i", "c", "v"]])
        return out[(out["j"] // side == key[1]) & (out["i"] // side == key[2])]

    return sent.groupBy("image_id", "tj", "ti").applyInPandas(run, f"image_id {kind}, j int, i int, c int, v double")


def accumulate_with(px: DataFrame, fn: Callable[[np.ndarray], float], by: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """One value per cell from its samples by a function of an array; a cell has one sample for each image."""
    own = px.where("v is not null").select(*by, F.col("v").cast("double").alias("v"))
    fields = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in by)
    return own.groupBy(*by).applyInPandas(lambda key, rows: pd.DataFrame([[*key, float(fn(rows["v"].to_numpy()))]], columns=[*by, "v"]), f"{fields}, v double")


def frechet(px: DataFrame, p: float, rounds: int = 25) -> DataFrame:
    """Position m of each cell that minimises the sum of |v - m|^p, p at least 1, by reweighted means from the mean; a sample at m is left out of a round."""
    own = materialise(px.where("v is not null").select("j", "i", F.col("v").cast("double").alias("v")))
    centre = own.groupBy("j", "i").agg(F.avg("v").alias("m"))
    for k in range(rounds):
        gap = F.abs(F.col("v") - F.col("m"))
        w = F.when(gap > 1e-12, F.pow(gap, F.lit(p - 2)))
        centre = own.join(centre, ["j", "i"]).groupBy("j", "i").agg(F.coalesce(F.sum(w * F.col("v")) / F.sum(w), F.first("m")).alias("m"))
        if k % 5 == 4:
            centre = materialise(centre)
    return centre.withColumnRenamed("m", "v")
