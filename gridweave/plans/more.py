"""Registered queries over regions, stencils, vectors, colours, shapes and descriptors, each with its SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import accumulate as A
from gridweave.operators import clusters as K
from gridweave.operators import colours as C
from gridweave.operators import descriptors as M
from gridweave.operators import fields as D
from gridweave.operators import motion as O
from gridweave.operators import neighbours as N
from gridweave.operators import pairs as R
from gridweave.operators import pixels as P
from gridweave.operators import regions as G
from gridweave.operators import shapes as H
from gridweave.operators import statistics as S
from gridweave.operators import vectors as V
from gridweave.operators import warps as W
from gridweave.plans.fixtures import load
from gridweave.plans.registry import QUERIES, add

_DIMS = "d AS (SELECT image_id, max(i) + 1 AS w, max(j) + 1 AS h FROM px GROUP BY 1)"
_SAME = "{b}.image_id = {a}.image_id AND {b}.c = {a}.c"
_BOX = "FROM px p JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) <= {r} AND abs(q.j - p.j) <= {r}"


def _stencil(source: str, weights: dict[int, float], axis: str) -> str:
    other = "j" if axis == "i" else "i"
    joins = " ".join(f"LEFT JOIN {source} s{k % 7} ON {_SAME.format(a='p', b=f's{k % 7}')} AND s{k % 7}.{other} = p.{other} AND s{k % 7}.{axis} = p.{axis} + {k}" for k in weights if k)
    total = " + ".join(f"{w!r} * " + ("p.v" if k == 0 else f"coalesce(s{k % 7}.v, p.v)") for k, w in weights.items())
    return f"SELECT p.image_id, p.j, p.i, p.c, {total} AS v FROM {source} p {joins}"


# accumulators
for _op in ("geo", "lav", "M0"):
    add(f"accumulate_{_op}_zero", "PE", lambda px, op=_op: A.accumulate(px.withColumn("v", F.floor(F.col("v") / 20)), op), "SELECT j, i, CASE WHEN min(v) = 0 THEN 0 WHEN min(v) > 0 THEN exp(avg(ln(CASE WHEN v > 0 THEN v END))) END AS v FROM (SELECT j, i, floor(v / 20) AS v FROM px) GROUP BY 1, 2")
_MODE = "SELECT j, i, CAST(arg_max(b, struct_pack(w := w, m := b = 128, b := -b)) AS DOUBLE) AS v FROM (SELECT j, i, b + d AS b, sum(g * (2 - abs(d))) AS w FROM (SELECT j, i, CASE WHEN x > -1 AND x < 256 THEN CAST(trunc(x) AS INT) ELSE 128 END AS b, CASE WHEN x > -1 AND x < 256 THEN 1 ELSE 0 END AS g FROM (SELECT j, i, {} AS x FROM px)), (VALUES (-1), (0), (1)) t(d) WHERE b + d BETWEEN 0 AND 255 GROUP BY 1, 2, 3) GROUP BY 1, 2"
add("accumulate_mod_signed", "PU", lambda px: A.accumulate(px.withColumn("v", F.col("v") - 60.5), "mod"), _MODE.format("v - 60.5"))
add("accumulate_H5_signed", "PU", lambda px: A.accumulate(px.withColumn("v", F.col("v") - 60.5), "H5"), _MODE.format("floor((v - 60.5) / 5) * 5"))
add("accumulate_iqd_few", "PE", lambda px: A.accumulate(px, "iqd"), "SELECT j, i, CASE WHEN count(v) = 3 THEN max(v) - min(v) ELSE list_sort(list(v))[CAST(floor((count(v) - 1) * 0.75 + 0.5) AS BIGINT) + 1] - list_sort(list(v))[CAST(floor((count(v) - 1) * 0.25 + 0.5) AS BIGINT) + 1] END AS v FROM px GROUP BY 1, 2")
add("accumulate_pmin", "PS", lambda px: A.accumulate(px, "pmin"), "SELECT j, i, CAST(arg_min(k, struct_pack(v := v, k := k)) AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY j, i ORDER BY image_id) - 1 AS k FROM px) GROUP BY 1, 2")
add("accumulate_with_median", "PS", lambda px: M.accumulate_with(px, np.median), "SELECT j, i, median(v) AS v FROM px GROUP BY 1, 2")
_VEC = lambda px: px.selectExpr("image_id", "j", "0 AS i", "i AS c", "v")
for _op, _sql in (("sum", "sum(v)"), ("avg", "avg(v)"), ("mul", "product(1 + v)")):
    add(f"vectors_{_op}", "PS", lambda px, op=_op: V.accumulate_vec(_VEC(px).withColumn("v", F.col("v") + (1 if op == "mul" else 0)), op), f"SELECT j, 0 AS i, i AS c, {_sql} AS v FROM px GROUP BY 1, 2, 3")
add("vectors_cprod", "PE", lambda px: V.accumulate_vec(px.select("image_id", "j", "i", F.lit(0).alias("c"), (F.col("v") / 50).alias("v")).unionByName(px.select("image_id", "j", "i", F.lit(1).alias("c"), (F.col("n") / 10.0).alias("v"))), "cprod"), "SELECT j, i, k AS c, CASE k WHEN 0 THEN r * cos(t) ELSE r * sin(t) END AS v FROM (SELECT j, i, product(sqrt(v / 50 * v / 50 + n / 10.0 * n / 10.0)) AS r, sum(atan2(n / 10.0, v / 50)) AS t FROM px GROUP BY 1, 2), (VALUES (0), (1)) m(k)")
add("vectors_med", "PS", lambda px: V.accumulate_vec(_VEC(px), "med"), ", x AS (SELECT image_id, j, list(v ORDER BY i) AS x FROM px GROUP BY 1, 2), s AS (SELECT a.image_id, a.j, sum(list_distance(a.x, b.x)) AS d FROM x a JOIN x b USING (j) GROUP BY 1, 2), m AS (SELECT j, arg_min(image_id, struct_pack(d := round(d, 9), k := image_id)) AS image_id FROM s GROUP BY 1) SELECT j, 0 AS i, i AS c, v FROM px JOIN m USING (j, image_id)")
add("vectors_modc", "PU", lambda px: V.accumulate_vec(px, "modc"), _MODE.format("v").replace("SELECT j, i, CAST", "SELECT j, i, 0 AS c, CAST"))
add("magnitudes", "PS", lambda px: V.magnitudes(_VEC(px)), "SELECT image_id, min(n) AS least, max(n) AS greatest, avg(n) AS mean_norm, count(*) AS pixels, count(DISTINCT x) AS different_pixels FROM (SELECT image_id, j, sqrt(sum(v * v)) AS n, list(v ORDER BY i) AS x FROM px GROUP BY 1, 2) GROUP BY 1")
add("halve_channels", "PS", lambda px: V.halve(_VEC(px)), "SELECT CAST(image_id AS VARCHAR) || '/' || CAST(i // 32 AS VARCHAR) AS image_id, j, 0 AS i, i % 32 AS c, v FROM px")
add("interleave_channels", "PS", lambda px: V.interleave(_VEC(px)), "SELECT image_id, j, 0 AS i, i % 32 * 2 + i // 32 AS c, v FROM px")
add("stack_channels", "PL", lambda px: V.stack_channels(px, P.affine(px, -1.0, 0.0)), "SELECT image_id, j, i, c, v FROM px UNION ALL SELECT image_id, j, i, c + 1, -v FROM px")

# regions
_LEVEL = "floor(n / 2)"
_REACH = "SELECT * FROM (WITH RECURSIVE m AS (SELECT image_id, j, i, c, {v} AS v FROM px), r AS (SELECT image_id, c, v, j, i, j AS lj, i AS li FROM m UNION SELECT r.image_id, r.c, r.v, q.j, q.i, r.lj, r.li FROM r JOIN m q ON q.image_id = r.image_id AND q.c = r.c AND q.v = r.v AND abs(q.i - r.i) + abs(q.j - r.j) = 1), f AS (SELECT image_id, c, v, j, i, min(struct_pack(lj := lj, li := li)) AS o, count(*) AS size FROM r GROUP BY 1, 2, 3, 4, 5) {out})"
_level = lambda px: px.select(*P.KEYS, F.floor(F.col("n") / 2).cast("double").alias("v"))
add("image_components", "PE", lambda px: G.components(_level(px)), _REACH.format(v=_LEVEL, out="SELECT image_id, j, i, c, v, o.lj AS lj, o.li AS li, size FROM f"))
add("region_list", "PE", lambda px: G.region_list(_level(px)), _REACH.format(v=_LEVEL, out="SELECT f.image_id, f.c, f.o.lj AS lj, f.o.li AS li, any_value(f.v) AS v, count(*) AS size, count(*) FILTER (WHERE (SELECT count(*) FROM m q WHERE q.image_id = f.image_id AND q.c = f.c AND q.v = f.v AND abs(q.i - f.i) + abs(q.j - f.j) = 1) < 4) AS boundary FROM f GROUP BY 1, 2, 3, 4"))
add("remove_small", "PE", lambda px: G.remove_small(_level(px), 3), _REACH.format(v=_LEVEL, out="SELECT image_id, j, i, c, CASE WHEN size > 3 THEN v END AS v FROM f"))
add("mask_flat_regions", "PE", lambda px: G.mask_flat_regions(_level(px), 4), _REACH.format(v=_LEVEL, out="SELECT image_id, j, i, c, CASE WHEN size < 4 THEN v END AS v FROM f"))
_HOLES = "WITH RECURSIVE d AS (SELECT image_id, c, max(i) AS w, max(j) AS h FROM (SELECT p.image_id, p.c, e.i, e.j FROM (SELECT DISTINCT image_id, c FROM px) p JOIN px e USING (image_id)) GROUP BY 1, 2), g AS (SELECT image_id, c, j, i FROM (SELECT *, unnest(generate_series(0, h)) AS j FROM d), LATERAL (SELECT unnest(generate_series(0, w)) AS i)), k AS (SELECT g.image_id, g.c, CAST(g.j AS INT) AS j, CAST(g.i AS INT) AS i, px.v FROM g LEFT JOIN px USING (image_id, c, j, i)), m AS (SELECT * FROM k WHERE v IS NULL), "
add("fill_boundary", "PE", G.fill_boundary, "SELECT * FROM (" + _HOLES + "r AS (SELECT image_id, c, j, i, j AS lj, i AS li FROM m UNION SELECT r.image_id, r.c, q.j, q.i, r.lj, r.li FROM r JOIN m q ON q.image_id = r.image_id AND q.c = r.c AND abs(q.i - r.i) + abs(q.j - r.j) = 1), o AS (SELECT image_id, c, j, i, min(struct_pack(lj := lj, li := li)) AS o FROM r GROUP BY 1, 2, 3, 4), b AS (SELECT o.image_id, o.c, o.o, avg(q.v) AS u FROM o JOIN k q ON q.image_id = o.image_id AND q.c = o.c AND q.v IS NOT NULL AND abs(q.i - o.i) + abs(q.j - o.j) = 1 GROUP BY 1, 2, 3) SELECT k.image_id, k.j, k.i, k.c, coalesce(k.v, b.u) AS v FROM k LEFT JOIN o USING (image_id, c, j, i) LEFT JOIN b ON b.image_id = o.image_id AND b.c = o.c AND b.o = o.o)")
_RELAX = "{b} AS (SELECT p.image_id, p.c, p.j, p.i, p.hole, CASE WHEN any_value(p.hole) AND count(q.v) > 0 THEN avg(q.v) ELSE any_value(p.v) END AS v FROM {a} p LEFT JOIN {a} q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) + abs(q.j - p.j) = 1 GROUP BY 1, 2, 3, 4, 5)"
add("fill_harmonic", "PE", lambda px: G.fill_harmonic(px, 3), "SELECT * FROM (" + _HOLES + "z0 AS (SELECT k.image_id, k.c, k.j, k.i, k.v IS NULL AS hole, coalesce(k.v, avg(k.v) OVER (PARTITION BY image_id, c)) AS v FROM k), " + ", ".join(_RELAX.format(a=f"z{k}", b=f"z{k + 1}") for k in range(3)) + " SELECT image_id, j, i, c, v FROM z3)")

# stencils and kernels
add("box_mean_holes", "PE", lambda px: N.box_mean(px, 2), f"SELECT p.image_id, p.j, p.i, p.c, avg(q.v) AS v {_BOX.format(r=2)} GROUP BY 1, 2, 3, 4")
add("integral_holes", "PE", N.integral, "SELECT p.image_id, p.j, p.i, p.c, sum(q.v) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.i <= p.i AND q.j <= p.j GROUP BY 1, 2, 3, 4")
_GRAD = "e AS (SELECT p.image_id, p.j, p.i, p.c, coalesce(r.v - p.v, 0) AS gx, coalesce(b.v - p.v, 0) AS gy FROM px p LEFT JOIN px r ON r.image_id = p.image_id AND r.c = p.c AND r.j = p.j AND r.i = p.i + 1 LEFT JOIN px b ON b.image_id = p.image_id AND b.c = p.c AND b.i = p.i AND b.j = p.j + 1)"
add("structure_tensor", "PE", lambda px: N.structure_tensor(px, 1), f", {_GRAD} SELECT p.image_id, p.j, p.i, p.c, avg(q.gx * q.gx) AS xx, avg(q.gx * q.gy) AS xy, avg(q.gy * q.gy) AS yy {_BOX.format(r=1).replace('px', 'e')} GROUP BY 1, 2, 3, 4")
add("derivative_forward", "PE", lambda px: N.derivative(px, "x", "forward"), _stencil("px", N.FORWARD, "i"))
add("derivative_sobel", "PE", lambda px: N.derivative(px, "y", "sobel"), f", a AS ({_stencil('px', N.CENTRED, 'j')}) {_stencil('a', N.SMOOTH['sobel'], 'i')}")
add("derivative_xy", "PE", lambda px: N.derivative(px, "xy"), f", a AS ({_stencil('px', N.CENTRED, 'i')}) {_stencil('a', N.CENTRED, 'j')}")
add("laplacian", "PE", lambda px: N.derivative(px, "l"), f", a AS ({_stencil('px', N.SECOND, 'i')}), b AS ({_stencil('px', N.SECOND, 'j')}) SELECT image_id, j, i, c, a.v + b.v AS v FROM a JOIN b USING (image_id, j, i, c)")
add("gradient_norm", "PE", lambda px: N.derivative(px, "n", "centred"), f", a AS ({_stencil('px', N.CENTRED, 'i')}), b AS ({_stencil('px', N.CENTRED, 'j')}) SELECT image_id, j, i, c, sqrt(a.v * a.v + b.v * b.v) AS v FROM a JOIN b USING (image_id, j, i, c)")
add("hessian", "PE", lambda px: N.derivative(px, "H"), f", z AS ({_stencil('px', N.CENTRED, 'i')}), a AS ({_stencil('px', N.SECOND, 'i')}), b AS ({_stencil('z', N.CENTRED, 'j')}), e AS ({_stencil('px', N.SECOND, 'j')}) SELECT image_id, j, i, 0 AS c, v FROM a UNION ALL SELECT image_id, j, i, 1, v FROM b UNION ALL SELECT image_id, j, i, 2, v FROM e")
for _op, _a, _b, _sign in (("d", "i", "j", "+"), ("r", "j", "i", "-")):
    # the field's channels are v and n
    _first, _second = ("(SELECT image_id, j, i, c, v FROM px)", "(SELECT image_id, j, i, c, CAST(n AS DOUBLE) AS v FROM px)")
    _x, _y = (("f", "g") if _op == "d" else ("g", "f"))
    add(f"field_{'divergence' if _op == 'd' else 'curl'}", "PE", lambda px, op=_op: N.flow_derivative(px.select("image_id", "j", "i", F.lit(0).alias("c"), "v").unionByName(px.select("image_id", "j", "i", F.lit(1).alias("c"), F.col("n").cast("double").alias("v"))), op, "centred"), f", f AS {_first}, g AS {_second}, a AS ({_stencil(_x, N.CENTRED, 'i')}), b AS ({_stencil(_y, N.CENTRED, 'j')}) SELECT image_id, j, i, c, a.v {_sign} b.v AS v FROM a JOIN b USING (image_id, j, i, c)")


def _kernel(name: str, width: float, radius: int | None = None) -> str:
    return "k AS (SELECT * FROM (VALUES " + ", ".join(f"({x}, {y}, CAST({w!r} AS DOUBLE))" for (x, y), w in N.kernel(name, width, radius).items()) + ") t(dx, dy, wt))"


add("blur_gauss", "PE", lambda px: N.blur(px, "gauss", 1.0), f", {_kernel('gauss', 1.0)} SELECT p.image_id, p.j, p.i, p.c, sum(wt * q.v) / sum(wt) AS v FROM px p, k JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.i = p.i + dx AND q.j = p.j + dy GROUP BY 1, 2, 3, 4")
add("blur_laplace_zero", "PE", lambda px: N.blur(px, "laplace", 0.7, "zero", complement=True), f", {_kernel('laplace', 0.7)} SELECT p.image_id, p.j, p.i, p.c, any_value(p.v) - sum(wt * q.v) / (SELECT sum(wt) FROM k) AS v FROM px p, k JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.i = p.i + dx AND q.j = p.j + dy GROUP BY 1, 2, 3, 4")
add("blur_cauchy_periodic", "PL", lambda px: N.blur(px, "cauchy", 0.6, "periodic"), f", {_DIMS}, {_kernel('cauchy', 0.6)} SELECT p.image_id, p.j, p.i, p.c, sum(wt * q.v) / sum(wt) AS v FROM px p JOIN d USING (image_id), k JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.i = (p.i + dx + 2 * w) % w AND q.j = (p.j + dy + 2 * h) % h GROUP BY 1, 2, 3, 4")
_SYMMETRIC = "CASE WHEN ((p.{k} + {d}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN ((p.{k} + {d}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - ((p.{k} + {d}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END"
for _name, _width in (("goodcauchy", 0.7), ("riesz", 0.5), ("log", 1.0)):
    add(f"blur_{_name}_symmetric", "PL", lambda px, name=_name, width=_width: N.blur(px, name, width, "symmetric", radius=3), f", {_DIMS}, {_kernel(_name, _width, 3)} SELECT p.image_id, p.j, p.i, p.c, sum(wt * q.v) / sum(wt) AS v FROM px p JOIN d USING (image_id), k JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.i = {_SYMMETRIC.format(k='i', d='dx', n='w')} AND q.j = {_SYMMETRIC.format(k='j', d='dy', n='h')} GROUP BY 1, 2, 3, 4")
add("smooth_structure_tensor", "PE", lambda px: N.smooth_structure_tensor(px, 1.0), f", {_GRAD}, {_kernel('gauss', 1.0)} SELECT p.image_id, p.j, p.i, p.c, " + ", ".join(f"sum(wt * q.g{a} * q.g{b}) / sum(wt) AS {a}{b}" for a, b in ("xx", "xy", "yy")) + " FROM e p, k JOIN e q ON q.image_id = p.image_id AND q.c = p.c AND q.i = p.i + dx AND q.j = p.j + dy GROUP BY 1, 2, 3, 4")
_DISK = f"FROM px p JOIN px q ON {_SAME.format(a='p', b='q')} AND (q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j) < 20.25"
for _op, _sql in (("erode", "min(q.v)"), ("dilate", "max(q.v)"), ("median_filter", "median(q.v)")):
    add(f"{_op}_disk", "PE", lambda px, op=_op: getattr(N, op)(px, N.element("disk4.5")), f"SELECT p.image_id, p.j, p.i, p.c, {_sql} AS v {_DISK} GROUP BY 1, 2, 3, 4")
add("morph_cblur", "PE", lambda px: N.morph(px, N.element("disk4.5"), "cblur"), f"SELECT p.image_id, p.j, p.i, p.c, any_value(p.v) / 2 + (min(q.v) + max(q.v)) / 4 AS v {_DISK} GROUP BY 1, 2, 3, 4")
_EXTREMES = f", lo AS (SELECT p.image_id, p.j, p.i, p.c, min(q.v) AS v {_DISK} GROUP BY 1, 2, 3, 4), hi AS (SELECT p.image_id, p.j, p.i, p.c, max(q.v) AS v {_DISK} GROUP BY 1, 2, 3, 4), op AS (SELECT p.image_id, p.j, p.i, p.c, max(q.v) AS v {_DISK.replace('px', 'lo')} GROUP BY 1, 2, 3, 4), cl AS (SELECT p.image_id, p.j, p.i, p.c, min(q.v) AS v {_DISK.replace('px', 'hi')} GROUP BY 1, 2, 3, 4)"
add("oscillation", "PE", lambda px: N.oscillation(px, N.element("disk4.5")), f"{_EXTREMES} SELECT image_id, j, i, c, cl.v - op.v AS v FROM cl JOIN op USING (image_id, j, i, c)")
add("bottomhat", "PE", lambda px: N.bottomhat(px, N.element("disk4.5")), f"{_EXTREMES} SELECT image_id, j, i, c, cl.v - px.v AS v FROM cl JOIN px USING (image_id, j, i, c)")
add("corner_measure", "PE", H.corner_measure, ", z AS (SELECT p.image_id, p.j, p.i, p.v, " + ", ".join(f"coalesce({n}.v, 0) AS {n}" for n in "rlba") + " FROM px p " + " ".join(f"LEFT JOIN px {n} ON {n}.image_id = p.image_id AND {n}.c = p.c AND {n}.i = p.i + {x} AND {n}.j = p.j + {y}" for n, x, y in (("r", 1, 0), ("l", -1, 0), ("b", 0, 1), ("a", 0, -1))) + ") SELECT image_id, j, i, 0 AS c, sum(4 * v - r - l - b - a - 0.04 * sqrt((r - l) * (r - l) + (b - a) * (b - a))) AS v FROM z GROUP BY 1, 2, 3")
add("nonmaximum_along", "PE", lambda px: H.nonmaximum_along(px, D.gradient(px)), ", g AS (SELECT p.*, (coalesce(r.v, p.v) - coalesce(l.v, p.v)) / 2 AS gx, (coalesce(b.v, p.v) - coalesce(a.v, p.v)) / 2 AS gy FROM px p " + " ".join(f"LEFT JOIN px {n} ON {n}.image_id = p.image_id AND {n}.c = p.c AND {n}.i = p.i + {x} AND {n}.j = p.j + {y}" for n, x, y in (("r", 1, 0), ("l", -1, 0), ("b", 0, 1), ("a", 0, -1))) + "), s AS (SELECT *, round_even(gx / nullif(sqrt(gx * gx + gy * gy), 0), 0) AS sx, round_even(gy / nullif(sqrt(gx * gx + gy * gy), 0), 0) AS sy FROM g) SELECT s.image_id, s.j, s.i, s.c, CASE WHEN sx IS NOT NULL AND s.v > coalesce(u.v, '-inf'::DOUBLE) AND s.v > coalesce(o.v, '-inf'::DOUBLE) THEN s.v ELSE 0 END AS v FROM s LEFT JOIN px u ON u.image_id = s.image_id AND u.c = s.c AND u.i = s.i + sx AND u.j = s.j + sy LEFT JOIN px o ON o.image_id = s.image_id AND o.c = s.c AND o.i = s.i - sx AND o.j = s.j - sy")

# colours
add("cast_u8", "PV", lambda px: C.cast_samples(P.affine(px, 700.0, 50.0), "u8"), "SELECT image_id, j, i, c, floor(greatest(0, least(255, v * 700.0 + 50))) AS v FROM px")
_RGB = "SELECT image_id, j, i, k AS c, CAST(CASE k WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END AS DOUBLE) AS v FROM {}, (VALUES (0), (1), (2)) m(k)"
add("sauto", "PV", C.sauto, ", t AS (SELECT image_id, list_sort(list(abs(v)))[CAST(greatest(0, trunc(count(v) - 1 - 5.0 * count(v) / 100)) AS BIGINT) + 1] AS t FROM px GROUP BY 1) " + _RGB.format("floor(255 * (1 - greatest(0, least(1, v / t))))", "floor(255 * (1 - greatest(0, least(1, abs(v / t)))))", "floor(255 * (1 + greatest(-1, least(0, v / t))))", "px JOIN t USING (image_id)"))
add("palette_nodes", "PV", lambda px: C.apply_palette(px, -0.3, 0.3, [(0, 0, 255), (255, 255, 255), (255, 0, 0)]), ", q AS (SELECT *, greatest(0, least(1, (v - -0.3) / (0.3 - -0.3))) * 2 AS x FROM px), z AS (SELECT *, least(floor(x), 1) AS f FROM q) " + _RGB.format("floor(CASE f WHEN 0 THEN 255 * x ELSE 255 END)", "floor(CASE f WHEN 0 THEN 255 * x ELSE 255 - 255 * (x - 1) END)", "floor(CASE f WHEN 0 THEN 255 ELSE 255 - 255 * (x - 1) END)", "z"))
add("palette_hot", "PV", lambda px: C.hot(px, -0.3, 0.3), ", z AS (SELECT *, greatest(0, least(255, 255.0 * (v - -0.3) / (0.3 - -0.3))) AS x FROM px) " + _RGB.format("floor(least(255, 3 * x))", "floor(x)", "floor(x)", "z"))
add("rgb_to_hsv", "PS", lambda px: C.rgb_to_hsv(_VEC(px).where("c < 3").withColumn("v", (F.col("v") + 1) / 2)), ", z AS (SELECT image_id, j, 0 AS i, max(CASE WHEN i = 0 THEN (v + 1) / 2 END) AS r, max(CASE WHEN i = 1 THEN (v + 1) / 2 END) AS g, max(CASE WHEN i = 2 THEN (v + 1) / 2 END) AS b FROM px GROUP BY 1, 2), y AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS gap FROM z) " + _RGB.format("CASE WHEN gap = 0 THEN 0 WHEN hi = r THEN (60 * (g - b) / gap + 360) % 360 WHEN hi = g THEN 60 * (b - r) / gap + 120 ELSE 60 * (r - g) / gap + 240 END", "CASE WHEN hi = 0 THEN 0 ELSE gap / hi END", "hi", "y"))

# shapes
add("hslice", "PL", lambda px: H.hslice(px, 7), f", {_DIMS} SELECT image_id, i, c, v FROM px JOIN d USING (image_id) WHERE j = greatest(0, least(7, h - 1))")
add("tile_inventory", "PV", lambda px: H.tile_inventory(px, 16, 16), f", {_DIMS} SELECT image_id, CAST(ceil(w / 16) AS INT) AS across, CAST(ceil(h / 16) AS INT) AS down, CAST(ceil(w / 16) * ceil(h / 16) AS INT) AS tiles FROM d")
add("crop_around", "PV", lambda px: H.crop_around(px, 20, 5, 4), "SELECT image_id, j - 1 AS j, i - 16 AS i, c, v FROM px WHERE i BETWEEN 16 AND 24 AND j BETWEEN 1 AND 9")
for _axis, _n in (("i", "w"), ("j", "h")):
    _other = "j" if _axis == "i" else "i"
    add(f"downsa_axis_{_axis}", "PV", lambda px, axis=_axis: H.downsa_axis(px, 2, axis), f", {_DIMS} SELECT image_id, {_axis} // 2 AS {_axis}, {_other}, c, avg(v) AS v FROM px JOIN d USING (image_id) WHERE ({_axis} // 2 + 1) * 2 <= {_n} GROUP BY image_id, {_axis} // 2, {_other}, c")
for _rule, _sql in (("i", "min(v)"), ("a", "max(v)"), ("s", "sqrt(var_pop(v) * count(v))"), ("n", "CAST(count(v) AS DOUBLE)"), ("e", "median(v)"), ("l", "CASE WHEN min(v) = 0 THEN 0 WHEN min(v) > 0 THEN exp(avg(ln(CASE WHEN v > 0 THEN v END))) END")):
    add(f"downsa_{_rule}", "PL", lambda px, rule=_rule: P.downsa(px, 3, rule), f", {_DIMS} SELECT image_id, j // 3 AS j, i // 3 AS i, c, {_sql} AS v FROM px JOIN d USING (image_id) WHERE (i // 3 + 1) * 3 <= w AND (j // 3 + 1) * 3 <= h GROUP BY 1, 2, 3, 4")
add("locate", "PL", lambda px: H.locate(P.crop(px.where("image_id = 'A'"), 4, 3, 8, 6), px), ", n AS (SELECT j - 3 AS nj, i - 4 AS ni, c, v FROM px WHERE image_id = 'A' AND i BETWEEN 4 AND 7 AND j BETWEEN 3 AND 5) SELECT image_id, p.x AS i, p.y AS j FROM (SELECT image_id, min(struct_pack(x := x, y := y)) AS p FROM (SELECT px.image_id, px.i - ni AS x, px.j - nj AS y FROM px JOIN n USING (c, v) GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM n)) GROUP BY 1)")
add("zip_parts", "PL", lambda px: H.zip_parts(V.stack_channels(px, P.affine(px, 2.0, 0.0), P.affine(px, 3.0, 0.0)), px), "SELECT image_id, i AS x, j AS y, v AS z, v AS red, 2 * v AS green, 3 * v AS blue FROM px")
add("segment_raster", "SEG", lambda s: H.segment_raster(s, 24, 100), "SELECT j, i, count(*) AS n FROM (SELECT CAST(floor(b + CASE WHEN n > 0 THEN (z - b) * k / n ELSE 0 END + 0.5) AS INT) AS j, CAST(floor(a + CASE WHEN n > 0 THEN (y - a) * k / n ELSE 0 END + 0.5) AS INT) AS i FROM (SELECT *, unnest(generate_series(0, CAST(n AS BIGINT))) AS k FROM (SELECT *, greatest(abs(y - a), abs(z - b)) AS n FROM (SELECT floor(x1 + 0.5) AS a, floor(y1 + 0.5) AS b, floor(x2 + 0.5) AS y, floor(y2 + 0.5) AS z FROM px)))) WHERE i BETWEEN 0 AND 23 AND j BETWEEN 0 AND 99 GROUP BY 1, 2")
add("spread", "PL", H.spread, f", {_DIMS}, z AS (SELECT image_id, v, CASE WHEN 2 * i >= w THEN i - w ELSE i END AS x, CASE WHEN 2 * j >= h THEN j - h ELSE j END AS y FROM px JOIN d USING (image_id)) SELECT image_id, sqrt(sum(v * (x * x + y * y)) / sum(v)) / 1.4 AS spread FROM z GROUP BY 1")
_CORNERS = ", q AS (SELECT p.image_id, list_sort([p.v, b.v, d.v, e.v]) AS q FROM px p JOIN px b ON b.image_id = p.image_id AND b.c = p.c AND b.j = p.j AND b.i = p.i + 1 JOIN px d ON d.image_id = p.image_id AND d.c = p.c AND d.j = p.j + 1 AND d.i = p.i JOIN px e ON e.image_id = p.image_id AND e.c = p.c AND e.j = p.j + 1 AND e.i = p.i + 1)"
_TRAPEZOID = "((CASE WHEN {x} <= a THEN 0 WHEN {x} >= b THEN 2 * {x} - a - b ELSE ({x} - a) * ({x} - a) / (b - a) END) - (CASE WHEN {x} <= c THEN 0 WHEN {x} >= d THEN 2 * {x} - c - d ELSE ({x} - c) * ({x} - c) / (d - c) END)) / (c + d - a - b)"
add("continuous_histogram", "PV", lambda px: H.continuous_histogram(px, 20, -0.5, 0.5), f"{_CORNERS}, e AS (SELECT image_id, q[1] AS a, q[2] AS b, q[3] AS c, q[4] AS d FROM q), k AS (SELECT CAST(unnest(generate_series(0, 19)) AS INT) AS bin) SELECT image_id, bin, sum(CASE WHEN a = d THEN CASE WHEN floor((a + 0.5) / 0.05) = bin THEN 1.0 ELSE 0.0 END ELSE {_TRAPEZOID.format(x='(-0.5 + (bin + 1) * 0.05)')} - {_TRAPEZOID.format(x='(-0.5 + bin * 0.05)')} END) AS mass FROM e, k GROUP BY 1, 2 HAVING mass > 1e-12")
add("density_by_jumps", "PV", lambda px: H.density_by_jumps(px, 40, -0.5, 0.5).withColumn("density", F.round("density", 6) + 0.0), f"""{_CORNERS}, t AS (SELECT image_id, [CAST(round_even(39 * (x - -0.5) / (0.5 - -0.5), 0) AS INT) FOR x IN q] AS p FROM q WHERE q[1] >= -0.5 AND q[4] <= 0.5 AND q[1] < q[2] AND q[2] < q[3] AND q[3] < q[4]),
    o AS (SELECT image_id, p, 2 / (p[3] + p[4] - p[1] - p[2]) AS m FROM t WHERE p[1] < p[2] AND p[2] < p[3] AND p[3] < p[4]),
    u AS (SELECT image_id, p[1] AS bin, m / (p[2] - p[1]) AS z FROM o UNION ALL SELECT image_id, p[2], -m / (p[2] - p[1]) FROM o UNION ALL SELECT image_id, p[3], -m / (p[4] - p[3]) FROM o UNION ALL SELECT image_id, p[4], m / (p[4] - p[3]) FROM o),
    n AS (SELECT image_id, bin FROM (SELECT DISTINCT image_id FROM px), (SELECT CAST(unnest(generate_series(0, 39)) AS INT) AS bin)),
    g AS (SELECT n.image_id, n.bin, coalesce(sum(z), 0) AS z FROM n LEFT JOIN u ON u.image_id = n.image_id AND u.bin = n.bin GROUP BY 1, 2)
    SELECT image_id, bin, -0.5 + bin * ((0.5 - -0.5) / 40) AS value, round(sum(s) OVER (PARTITION BY image_id ORDER BY bin), 6) + 0.0 AS density FROM (SELECT image_id, bin, sum(z) OVER (PARTITION BY image_id ORDER BY bin) AS s FROM g)""")
add("fit_curves", "PU", lambda px: H.fit_curves(S.histogram(px)), ", t AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY 1, 2), m AS (SELECT image_id, sum(n) AS mass, sum(v * n) / sum(n) AS mean, sqrt(greatest(0, sum(v * v * n) / sum(n) - sum(v * n) / sum(n) * (sum(v * n) / sum(n)))) AS sigma FROM t GROUP BY 1) SELECT image_id, v, n, CAST(mass AS BIGINT) AS mass, mean, sigma, exp(-(v - mean) * (v - mean) / (2 * sigma * sigma)) / (sigma * sqrt(2 * pi())) AS gauss, exp(-abs(v - mean) * sqrt(2) / sigma) / (sigma * sqrt(2)) AS laplace FROM t JOIN m USING (image_id)")
add("line_profile", "PL", lambda px: H.line_profile(px, 0.3, 21), f", {_DIMS}, k AS (SELECT *, CAST(unnest(generate_series(0, 20)) AS INT) AS k FROM d), t AS (SELECT *, (w - 1) / 2.0 + (k / 20.0 - 0.5) * (least(w, h) - 1) * {math.cos(0.3)!r} AS x, (h - 1) / 2.0 + (k / 20.0 - 0.5) * (least(w, h) - 1) * {math.sin(0.3)!r} AS y FROM k), o AS (SELECT *, floor(x) + a AS si, floor(y) + b AS sj, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS wt FROM t, (VALUES (0), (1)) m(a), (VALUES (0), (1)) n(b)) SELECT o.image_id, px.c, o.k, sum(wt * v) / sum(wt) AS v FROM o JOIN px ON px.image_id = o.image_id AND px.i = si AND px.j = sj WHERE wt > 1e-12 GROUP BY 1, 2, 3")
add("disparity_to_pairs", "PL", lambda px: H.disparity_to_pairs(px, [1, 0.5, 3, 0, 2, -1, 0, 0.001, 1], [1, 0, 0, 0, 1, 0, 0, 0, 2]), "SELECT image_id, (i + 0.5 * j + 3) / (0.001 * j + 1) AS x1, (2 * j - 1) / (0.001 * j + 1) AS y1, (i + v) / 2.0 AS x2, j / 2.0 AS y2 FROM px")
add("sort_samples", "PU", lambda px: S.sort_samples(px, 24), "SELECT image_id, CAST((k - 1) // 24 AS INT) AS j, CAST((k - 1) % 24 AS INT) AS i, 0 AS c, v FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v, c, j, i) AS k FROM px)")
_F, _N = 1 / 298.257223563, (1 / 298.257223563) / (2 - 1 / 298.257223563)
_RADIUS, _K = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64), 2 * math.sqrt(_N) / (1 + _N)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_EAST, _NORTH = (" + ".join(f"{a!r} * {f}({2 * (m + 1)} * xi) * {g}({2 * (m + 1)} * eta)" for m, a in enumerate(_ALPHA)) for f, g in (("cos", "sinh"), ("sin", "cosh")))
add("to_utm", "PTS", lambda p: H.to_utm(p.select("id", (F.col("x") * 7 - 178).alias("lon"), (F.col("y") / 25).alias("lat"))), f", q AS (SELECT id, x * 7 - 178 AS lon, y / 25 AS lat FROM px), z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 AS zone FROM q), r AS (SELECT *, radians(lat) AS p, radians(lon - (zone * 6 - 183)) AS l FROM z), t AS (SELECT *, sinh(atanh(sin(p)) - {_K!r} * atanh({_K!r} * sin(p))) AS t FROM r), e AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t) SELECT id, lon, lat, zone, 500000 + {0.9996 * _RADIUS!r} * (eta + {_EAST}) AS east, {0.9996 * _RADIUS!r} * (xi + {_NORTH}) AS north FROM e")
for _kind, _fn in (("dct", "2 * cos(pi() * k * (2 * {x} + 1) / (2 * {n}))"), ("dht", "(cos(2 * pi() * k * {x} / {n}) + sin(2 * pi() * k * {x} / {n}))")):
    add(f"{_kind}2", "PL", lambda px, kind=_kind: H.real_transform(px, kind), f", {_DIMS}, r AS (SELECT image_id, w, h, c, j, k AS i, sum(v * {_fn.format(x='i', n='w')}) AS v FROM px JOIN d USING (image_id), (SELECT CAST(unnest(generate_series(0, 15)) AS INT) AS k) WHERE k < w GROUP BY image_id, w, h, c, j, k) SELECT image_id, c, k AS j, i, sum(v * {_fn.format(x='j', n='h')}) AS v FROM r, (SELECT CAST(unnest(generate_series(0, 31)) AS INT) AS k) WHERE k < h GROUP BY image_id, c, k, i")

# descriptors
_PAIRS = "SELECT a.id AS \"from\", b.id AS \"to\", list_distance(CAST(a.descr AS DOUBLE[]), CAST(b.descr AS DOUBLE[])) AS d FROM px a, px b WHERE a.side = 'a' AND b.side = 'b'"
_sides = lambda k: (k.where("side = 'a'"), k.where("side = 'b'"))
add("match_nearest", "KP", lambda k: M.match_nearest(*_sides(k), 2.0, k=2), f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY \"from\" ORDER BY d, \"to\") AS INT) AS nth FROM ({_PAIRS}) WHERE d < 2) WHERE nth <= 2")
add("match_topped", "KP", lambda k: M.match_nearest(*_sides(k), 2.0, top=0.9), f"SELECT * FROM (SELECT \"from\", \"to\", d, CAST(row_number() OVER (PARTITION BY \"from\" ORDER BY d, \"to\") AS INT) AS nth FROM (SELECT \"from\", \"to\", least(d, 0.9) AS d FROM ({_PAIRS})) WHERE d < 2) WHERE nth <= 1")
add("match_all", "KP", lambda k: M.match_all(*_sides(k), 1.1), f"SELECT * FROM ({_PAIRS}) WHERE d < 1.1")
add("epipolar_error", "SEG", lambda d: R.epipolar_error(d, [0.1, 0.02, -3, 0.01, 0.3, 1, 2, -1, 5]), "SELECT *, abs((0.1 * x1 + 0.02 * y1 - 3) * x2 + (0.01 * x1 + 0.3 * y1 + 1) * y2 + 2 * x1 - y1 + 5) / nullif(sqrt(pow(0.1 * x1 + 0.02 * y1 - 3, 2) + pow(0.01 * x1 + 0.3 * y1 + 1, 2)), 0) AS error FROM px")
add("match_epipolar", "KP", lambda k: M.match_epipolar(*_sides(k), [0, 0, 0.1, 0, 0, 1, 0, -1, 0], 2.0, 4.0), "SELECT \"from\", \"to\", d FROM (SELECT a.id AS \"from\", b.id AS \"to\", list_distance(CAST(a.descr AS DOUBLE[]), CAST(b.descr AS DOUBLE[])) AS d FROM px a, px b WHERE a.side = 'a' AND b.side = 'b' AND abs(0.1 * b.x + b.y - a.y) / sqrt(1.01) <= 2) WHERE d < 2 QUALIFY row_number() OVER (PARTITION BY \"from\" ORDER BY d, \"to\") = 1")
add("dedup_keypoints", "KP", lambda k: M.dedup_keypoints(k, 6.0, 1.3).select("id", "side", "x", "y"), """, n AS (SELECT p.id, list(q.id) FILTER (WHERE q.id IS NOT NULL) AS near FROM px p LEFT JOIN px q ON q.id > p.id AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < 6 AND list_distance(CAST(p.descr AS DOUBLE[]), CAST(q.descr AS DOUBLE[])) < 1.3 GROUP BY 1),
    o AS (SELECT id, coalesce(near, []) AS near, row_number() OVER (ORDER BY id DESC) AS k FROM n)
    SELECT id, side, x, y FROM px WHERE id IN (WITH RECURSIVE g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT o.k, CASE WHEN list_has_any(o.near, g.kept) THEN g.kept ELSE list_append(g.kept, o.id) END FROM g JOIN o ON o.k = g.k + 1) SELECT unnest(kept) FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1))""")
_CIRCLES = "SELECT id, CAST(x * 4 AS INT) AS x, CAST(floor(y / 10) AS INT) AS y, CAST(x AS INT) % 9 AS r FROM px"
add("circle_raster", "PTS", lambda p: H.circle_raster(p.selectExpr("id", "x * 4 AS x", "floor(y / 10) AS y", "x % 9 AS r"), 190, 150), f", k AS ({_CIRCLES}), o AS (SELECT id, x, y, r, unnest(generate_series(-r, r)) AS a FROM k), b AS (SELECT *, CAST(floor(sqrt(r * r - a * a) + 0.5) AS INT) AS b FROM o), d AS (SELECT id, r, y + b AS j, x + a AS i FROM b WHERE abs(a) <= b UNION SELECT id, r, y - b, x + a FROM b WHERE abs(a) <= b UNION SELECT id, r, y + a, x + b FROM b WHERE abs(a) <= b UNION SELECT id, r, y + a, x - b FROM b WHERE abs(a) <= b) SELECT j, i, count(*) AS n, sum(r) AS radii FROM d WHERE i BETWEEN 0 AND 189 AND j BETWEEN 0 AND 149 GROUP BY 1, 2")
add("polygon_raster", "PTS", lambda p: H.segment_raster(H.curve_segments(p.selectExpr("(id - 1) div 5 AS id", "(id - 1) % 5 AS k", "x * 4 AS x", "floor(y / 10) AS y"), True), 210, 210), ", p AS (SELECT (id - 1) // 5 AS id, (id - 1) % 5 AS k, CAST(x * 4 AS INT) AS x1, CAST(floor(y / 10) AS INT) AS y1 FROM px), s AS (SELECT x1, y1, coalesce(lead(x1) OVER (PARTITION BY id ORDER BY k), CASE WHEN count(*) OVER (PARTITION BY id) > 2 THEN first_value(x1) OVER (PARTITION BY id ORDER BY k) END) AS x2, coalesce(lead(y1) OVER (PARTITION BY id ORDER BY k), CASE WHEN count(*) OVER (PARTITION BY id) > 2 THEN first_value(y1) OVER (PARTITION BY id ORDER BY k) END) AS y2 FROM p), n AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1)) AS n FROM s WHERE x2 IS NOT NULL), t AS (SELECT *, unnest(generate_series(0, n)) AS k FROM n) SELECT CAST(floor(y1 + CASE WHEN n > 0 THEN (y2 - y1) * k / n ELSE 0 END + 0.5) AS INT) AS j, CAST(floor(x1 + CASE WHEN n > 0 THEN (x2 - x1) * k / n ELSE 0 END + 0.5) AS INT) AS i, count(*) AS n FROM t GROUP BY 1, 2 HAVING i BETWEEN 0 AND 209 AND j BETWEEN 0 AND 209")
add("segments_in_mask", "SEG", lambda s: R.segments_in_mask(s, s.select(F.lit(0).alias("c"), F.floor(F.col("y1") / 7 + 0.5).cast("int").alias("j"), F.col("x1").cast("int").alias("i"), F.lit(1.0).alias("v"))), ", m AS (SELECT DISTINCT CAST(floor(y1 / 7 + 0.5) AS INT) AS j, CAST(x1 AS INT) AS i FROM px) SELECT * FROM px s WHERE EXISTS (SELECT 1 FROM m WHERE (m.j = floor(s.y1 + 0.5) AND m.i = floor(s.x1 + 0.5)) OR (m.j = floor(s.y2 + 0.5) AND m.i = floor(s.x2 + 0.5)))")


def _tile_max(rows: pd.DataFrame) -> pd.DataFrame:
    """Greatest value in the 3x3 square around each pixel of a tile."""
    moved = [rows.assign(j=rows["j"] + y, i=rows["i"] + x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    top = pd.concat(moved).groupby(["image_id", "j", "i", "c"], as_index=False)["v"].max()
    return rows.drop(columns="v").merge(top, on=["image_id", "j", "i", "c"])


def map_tiles(px: DataFrame) -> DataFrame:
    return M.map_tiles(px, _tile_max, 8, 1)


add("map_tiles", "PL", map_tiles, f"SELECT p.image_id, p.j, p.i, p.c, max(q.v) AS v {_BOX.format(r=1)} GROUP BY 1, 2, 3, 4")

# motion: b is the image itself, moved, brightened or with its count as samples
_CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
_MOVES = "(VALUES " + ", ".join(f"({x}, {y})" for x, y in _CROSS) + ") m(dx, dy)"
_moved = lambda px: P.affine(P.shift(px, 1, 0, "periodic"), 1.0, 0.5)
_MOVED = f", {_DIMS}, b AS (SELECT p.image_id, p.j, p.i, p.c, q.v + 0.5 AS v FROM px p JOIN d USING (image_id) LEFT JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.j = p.j AND q.i = (p.i + 1) % d.w)"
add("channel_costs", "PL", lambda px: O.channel_costs(px, _moved(px), _CROSS), f"{_MOVED} SELECT px.image_id, dx, dy, avg(coalesce((px.v - b.v) * (px.v - b.v), 1000)) AS cost FROM px CROSS JOIN {_MOVES} LEFT JOIN b ON b.image_id = px.image_id AND b.c = px.c AND b.i = px.i + dx AND b.j = px.j + dy AND b.v IS NOT NULL GROUP BY 1, 2, 3")
_COSTS = f"s AS (SELECT px.image_id, px.j, px.i, px.c, dx, dy, (px.v - b.v) * (px.v - b.v) AS e FROM px, {_MOVES}, b WHERE b.image_id = px.image_id AND b.c = px.c AND b.i = px.i + dx AND b.j = px.j + dy AND b.v IS NOT NULL), t AS (SELECT p.image_id, p.j, p.i, p.c, p.dx, p.dy, avg(q.e) AS cost FROM s p JOIN s q ON q.image_id = p.image_id AND q.c = p.c AND q.dx = p.dx AND q.dy = p.dy AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1 GROUP BY 1, 2, 3, 4, 5, 6)"
add("block_match", "PL", lambda px: O.block_match(px, _moved(px), 1, _CROSS).select(*P.KEYS, F.round("cost", 4).alias("cost")), f"{_MOVED}, {_COSTS} SELECT image_id, j, i, c, round(min(cost), 4) AS cost FROM t GROUP BY 1, 2, 3, 4")
_FLOW = ", b AS (SELECT image_id, j, i, c, v * 1.5 + 1 AS v FROM px)"
add("least_squares_flow", "PL", lambda px: O.least_squares_flow(px, P.affine(px, 1.5, 1.0), 1), f"{_FLOW}, x AS ({_stencil('px', N.CENTRED, 'i')}), y AS ({_stencil('px', N.CENTRED, 'j')}), g AS (SELECT image_id, j, i, c, x.v AS gx, y.v AS gy, b.v - px.v AS gt FROM px JOIN b USING (image_id, j, i, c) JOIN x USING (image_id, j, i, c) JOIN y USING (image_id, j, i, c)), z AS (SELECT p.image_id, p.j, p.i, p.c, avg(q.gx * q.gx) AS xx, avg(q.gx * q.gy) AS xy, avg(q.gy * q.gy) AS yy, avg(q.gx * q.gt) AS xt, avg(q.gy * q.gt) AS yt {_BOX.format(r=1).replace('px', 'g')} GROUP BY 1, 2, 3, 4) SELECT image_id, j, i, c, CASE WHEN xx * yy - xy * xy > 1e-9 THEN (xy * yt - yy * xt) / (xx * yy - xy * xy) END AS u, CASE WHEN xx * yy - xy * xy > 1e-9 THEN (xy * xt - xx * yt) / (xx * yy - xy * xy) END AS w FROM z")
add("lucky_rank", "PL", lambda px: O.lucky_rank(px, 1, 2), ", m AS (SELECT j, i, c, avg(v) AS m FROM px GROUP BY 1, 2, 3), g AS (SELECT px.*, (v - m) * (v - m) AS e FROM px JOIN m USING (j, i, c)), z AS (SELECT p.image_id, p.j, p.i, p.c, any_value(p.v) AS v, avg(q.e) AS d FROM g p JOIN g q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1 GROUP BY 1, 2, 3, 4) SELECT j, i, c, v, image_id AS frame FROM z QUALIFY row_number() OVER (PARTITION BY j, i, c ORDER BY round(d, 6), image_id) = 2")
add("local_gaussian", "PE", lambda px: O.local_gaussian(px, px.select("image_id", "j", "i", (F.col("n") / 4.0).alias("v"))), "SELECT p.image_id, p.j, p.i, p.c, sum(wt * q.v) / sum(wt) AS v FROM (SELECT a.image_id, a.j, a.i, a.c, b.v, CASE WHEN a.n / 4.0 < 0.1 THEN 1 ELSE exp(-((b.i - a.i) * (b.i - a.i) + (b.j - a.j) * (b.j - a.j)) / (2 * (a.n / 4.0) * (a.n / 4.0))) END AS wt FROM px a JOIN px b ON b.image_id = a.image_id AND b.c = a.c AND greatest(abs(b.i - a.i), abs(b.j - a.j)) <= CASE WHEN a.n / 4.0 < 0.1 THEN 0 ELSE least(19, ceil(3 * a.n / 4.0)) END) p, (SELECT 1) q GROUP BY 1, 2, 3, 4".replace("q.v", "v"))
add("windowed_spectrum", "TS", lambda s: O.windowed_spectrum(s, "event_type", "t", 8).select("event_type", "start", "k", *((F.round(x, 6) + 0.0).alias(x) for x in ("re", "im"))), 'SELECT a.event_type, a.t AS start, k, round(sum(b.v * cos(2 * pi() / 8 * k * (b.t - a.t))), 6) + 0.0 AS re, round(-sum(b.v * sin(2 * pi() / 8 * k * (b.t - a.t))), 6) + 0.0 AS im FROM px a JOIN px b ON b.event_type = a.event_type AND b.t >= a.t AND b.t < a.t + 8, (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS k) GROUP BY 1, 2, 3')


# fields and motion
_bent = lambda px: px.where("c = 0").select("image_id", "j", "i", (F.pmod(F.col("v"), F.lit(7.0)) / 10 - 0.3).alias("dx"), (F.pmod(F.col("v"), F.lit(5.0)) / 10 - 0.2).alias("dy"))
_CORNER = "coalesce((CASE m.a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE n.b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END), 0)"
_UNDO = "{b} AS (SELECT image_id, j, i, CASE WHEN count(dx) = count(*) THEN -sum(wt * dx) END AS dx, CASE WHEN count(dx) = count(*) THEN -sum(wt * dy) END AS dy FROM (SELECT z.image_id, z.j, z.i, u.dx, u.dy, z.wt FROM (SELECT t.*, floor(x) + m.a AS si, floor(y) + n.b AS sj, " + _CORNER + " AS wt FROM (SELECT k.image_id, k.j, k.i, greatest(0, least(w, k.i + k.dx)) AS x, greatest(0, least(h, k.j + k.dy)) AS y FROM {a} k JOIN s USING (image_id) WHERE k.dx IS NOT NULL AND k.dy IS NOT NULL) t, (VALUES (0), (1)) m(a), (VALUES (0), (1)) n(b)) z LEFT JOIN u ON u.image_id = z.image_id AND u.i = z.si AND u.j = z.sj WHERE z.wt > 0) GROUP BY 1, 2, 3)"
add("invert_field", "PL", lambda px: W.invert_field(_bent(px), rounds=2, tolerance=0.0), ", u AS (SELECT image_id, j, i, v % 7 / 10 - 0.3 AS dx, v % 5 / 10 - 0.2 AS dy FROM px), s AS (SELECT image_id, max(i) AS w, max(j) AS h FROM u GROUP BY 1), v0 AS (SELECT image_id, j, i, -dx AS dx, -dy AS dy FROM u), " + _UNDO.format(a="v0", b="v1") + ", " + _UNDO.format(a="v1", b="v2") + " SELECT u.image_id, u.j, u.i, v2.dx, v2.dy FROM u LEFT JOIN v2 USING (image_id, j, i)")
QUERIES["block_match_scales"] = lambda spark, sf_dir: (lambda px: O.block_match_scales(px, P.shift(px, -3, 2, "null"), 2, 3))(load(spark, sf_dir, "PL"))
QUERIES["harmonic"] = lambda spark, sf_dir: G.harmonic(load(spark, sf_dir, "PE").select(*P.KEYS, "v"))

# clusters of cells
_cents = lambda px: px.withColumn("v", F.col("v") * 100)
add("cluster_counts", "PS", lambda px: K.counted(_cents(px), 2.0), "SELECT j, i, floor(v * 100 / 2 + 0.5) * 2 AS v, count(*) AS n FROM px GROUP BY 1, 2, 3")
add("cluster_contrario", "PS", lambda px: K.cluster(_cents(px), "contrario", 1.0), """, s AS (SELECT j, i, v * 100 AS v FROM px), d AS (SELECT j, i, min(v) AS lo, CAST(floor((max(v) - min(v)) / 5) AS INT) + 1 AS size, count(*) AS n FROM s GROUP BY 1, 2),
    h AS (SELECT j, i, CAST(floor((v - lo) / 5) AS INT) AS bin, count(*) AS k FROM s JOIN d USING (j, i) GROUP BY 1, 2, 3),
    x AS (SELECT d.*, a, b FROM d, (SELECT CAST(unnest(generate_series(0, 60)) AS INT) AS a), (SELECT CAST(unnest(generate_series(0, 60)) AS INT) AS b) WHERE a <= b AND b < size),
    y AS (SELECT x.j, x.i, lo, size, n, a, b, coalesce(sum(k), 0) AS k FROM x LEFT JOIN h ON h.j = x.j AND h.i = x.i AND bin BETWEEN a AND b GROUP BY 1, 2, 3, 4, 5, 6, 7),
    r AS (SELECT *, k / n AS r, (b - a + 1) / size AS p FROM y),
    e AS (SELECT *, CASE WHEN p >= 1 THEN 0 ELSE (CASE WHEN r > 0 THEN r * ln(r / p) ELSE 0 END) + (CASE WHEN r < 1 THEN (1 - r) * ln((1 - r) / (1 - p)) ELSE 0 END) END AS e FROM r),
    m AS (SELECT * FROM e WHERE e >= ln(size * (size + 1) / 2.0) / n),
    g AS (SELECT * FROM m WHERE r >= p AND NOT EXISTS (SELECT 1 FROM m y WHERE y.j = m.j AND y.i = m.i AND y.r < y.p AND y.a >= m.a AND y.b <= m.b)),
    k AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.j = g.j AND y.i = g.i AND y.a >= g.a AND y.b <= g.b AND y.e > g.e) AND NOT EXISTS (SELECT 1 FROM g y WHERE y.j = g.j AND y.i = g.i AND y.a <= g.a AND y.b >= g.b AND y.b - y.a > g.b - g.a AND y.e >= g.e)),
    z AS (SELECT k.j, k.i, a, row_number() OVER (PARTITION BY k.j, k.i ORDER BY a) AS c, avg(v) AS v FROM k JOIN s ON s.j = k.j AND s.i = k.i AND v BETWEEN lo + 5 * a AND lo + 5 * (b + 1) GROUP BY k.j, k.i, a),
    t AS (SELECT j, i, CAST(least(7, count(*)) AS DOUBLE) AS k FROM z GROUP BY 1, 2)
    SELECT d.j, d.i, CAST(w.c AS INT) AS c, CASE WHEN w.c = 0 THEN coalesce(t.k, 0) ELSE z.v END AS v FROM d CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS c) w LEFT JOIN z ON z.j = d.j AND z.i = d.i AND z.c = w.c LEFT JOIN t ON t.j = d.j AND t.i = d.i""")
QUERIES["cluster_kmeans"] = lambda spark, sf_dir: K.cluster(_cents(load(spark, sf_dir, "PS")), "kmeans", 5.0, step=1.0)
QUERIES["cluster_kmedians"] = lambda spark, sf_dir: K.cluster(_cents(load(spark, sf_dir, "PS")), "kmedians", 8.0, step=1.0)

# parts, coordinates and lookups
add("band_slice", "PS", lambda px: P.band_slice(_VEC(px).where("c = 0").withColumn("v", F.pmod("image_id", F.lit(70)).cast("double")), _VEC(px)), "SELECT a.image_id, a.j, 0 AS i, 0 AS c, b.v FROM (SELECT * FROM px WHERE i = 0) a LEFT JOIN px b ON b.image_id = a.image_id AND b.j = a.j AND b.i = a.image_id % 70")
add("component", "PS", lambda px: P.component(_VEC(px), 7), "SELECT image_id, j, 0 AS i, 0 AS c, v FROM px WHERE i = 7")
add("with_coords", "PE", lambda px: P.with_coords(px).select(*P.KEYS, "x", "y", "r", "t", "place"), f", {_DIMS} SELECT image_id, j, i, c, 2.0 * i / w - 1 AS x, 2.0 * j / h - 1 AS y, sqrt(pow(2.0 * i / w - 1, 2) + pow(2.0 * j / h - 1, 2)) AS r, atan2(2.0 * j / h - 1, 2.0 * i / w - 1) AS t, j * w + i AS place FROM px JOIN d USING (image_id)")
add("with_stats", "PE", lambda px: P.with_stats(px).select(*P.KEYS, "lo", "hi", "mean", "total", "sigma"), "SELECT p.image_id, j, i, c, lo, hi, mean, total, sigma FROM px p JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi, avg(v) AS mean, sum(v) AS total, stddev_pop(v) AS sigma FROM px GROUP BY 1) USING (image_id)")
add("lookup", "PE", lambda px: P.lookup(px, px.select("image_id", (F.col("j") + 2).alias("j"), (F.col("i") + 1).alias("i")), "null").select("image_id", "j", "i", "v"), "SELECT a.image_id, a.j + 2 AS j, a.i + 1 AS i, b.v FROM px a LEFT JOIN px b ON b.image_id = a.image_id AND b.j = a.j + 2 AND b.i = a.i + 1")
add("shortest_vector", "PS", lambda px: R.extreme_vector(_VEC(px), longest=False), "SELECT j, 0 AS i, i AS c, v FROM px JOIN (SELECT j, arg_min(image_id, struct_pack(s := s, k := image_id)) AS image_id FROM (SELECT image_id, j, sum(v * v) AS s FROM px GROUP BY 1, 2) GROUP BY 1) USING (j, image_id)")
add("channel_histograms", "PU", lambda px: S.histogram(px, ("image_id", "c")), "SELECT *, CAST(sum(n) OVER (PARTITION BY image_id, c ORDER BY v) AS BIGINT) AS cum FROM (SELECT image_id, c, v, count(*) AS n FROM px GROUP BY 1, 2, 3)")
_BITS = " + ".join(f"{1 << k} * CAST(coalesce(n{k}.v > p.v, FALSE) AS INT)" for k in range(8))
add("census", "PE", N.census, f"SELECT p.image_id, p.j, p.i, p.c, CAST({_BITS} AS DOUBLE) AS v FROM px p " + " ".join(f"LEFT JOIN px n{k} ON {_SAME.format(a='p', b=f'n{k}')} AND n{k}.i = p.i + {x} AND n{k}.j = p.j + {y}" for k, (x, y) in enumerate([(x, y) for y in (-1, 0, 1) for x in (-1, 0, 1) if x or y])))
