"""The registered queries over rasters, points and series, each with its SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import accumulate as A
from gridweave.operators import neighbours as N
from gridweave.operators import pixels as P
from gridweave.operators import points as T
from gridweave.operators import statistics as S
from gridweave.plans import more, resampling  # noqa: F401 - register their own
from gridweave.plans.fixtures import load
from gridweave.plans.registry import NEXT, ORACLE_SQL, QUERIES, add

_CELL = "SELECT j, i, {} AS v FROM px GROUP BY 1, 2"
_SORTED = "list_sort(list(v))[CAST({} AS BIGINT) + 1]"
_SCALAR = {
    "sum": "sum(v)", "mul": "product(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "medv": "median(v)", "cnt": "count(v)",
    "med": _SORTED.format("CASE WHEN count(v) = 2 THEN 0 ELSE count(v) // 2 END"), "first": "arg_min(v, image_id)", "euc": "sqrt(avg(v * v))", "lse": "ln(avg(exp(v)))", "std": "stddev_pop(v)",
    "iqd": f"CASE WHEN count(v) = 3 THEN max(v) - min(v) ELSE {_SORTED.format('floor((count(v) - 1) * 0.75 + 0.5)')} - {_SORTED.format('floor((count(v) - 1) * 0.25 + 0.5)')} END", "q10": _SORTED.format("floor((count(v) - 1) * 0.1 + 0.5)"),
}
for _op, _sql in _SCALAR.items():
    add(f"accumulate_{_op}", "PS", lambda px, op=_op: A.accumulate(px, op), _CELL.format(_sql))
_LOG_AVERAGE = "CASE WHEN min(v) = 0 THEN 0 WHEN min(v) > 0 THEN exp(avg(ln(CASE WHEN v > 0 THEN v END))) END"
_MEANS = {
    "geo": _LOG_AVERAGE, "har": "CASE WHEN count(*) FILTER (WHERE v = 0) > 0 THEN 0 ELSE count(v) / sum(1 / nullif(v, 0)) END", "lav": _LOG_AVERAGE, "M3": "pow(avg(pow(v, 3)), 1 / 3.0)", "L2": "sum(pow(v, 2)) / sum(v)", "G3,1": "pow(sum(pow(v, 3)) / sum(v), 1 / 2.0)",
}
for _op, _sql in _MEANS.items():
    add("accumulate_" + _op.replace(",", "_"), "PE", lambda px, op=_op: A.accumulate(px, op), "SELECT j, i, " + _sql + " AS v FROM px GROUP BY 1, 2")
# drawn by Spark's own hash, which SQL elsewhere lacks: tested by properties
QUERIES["accumulate_rnd"] = lambda spark, sf_dir: A.accumulate(load(spark, sf_dir, "PS"), "rnd")
add("accumulate_pmax", "PS", lambda px: A.accumulate(px, "pmax"), "SELECT j, i, CAST(arg_max(k, struct_pack(v := v, k := -k)) AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY j, i ORDER BY image_id) - 1 AS k FROM px) GROUP BY 1, 2")
_MODE = "SELECT j, i, CAST(arg_max(b, struct_pack(w := w, m := b = 128, b := -b)) AS DOUBLE) AS v FROM (SELECT j, i, b, sum(w) AS w FROM (SELECT j, i, trunc({}) + d AS b, 2 - abs(d) AS w FROM px, (VALUES (-1), (0), (1)) t(d)) WHERE b BETWEEN 0 AND 255 GROUP BY 1, 2, 3) GROUP BY 1, 2"
add("accumulate_H5", "PU", lambda px: A.accumulate(px, "H5"), _MODE.format("floor(v / 5) * 5"))
add("accumulate_mod", "PU", lambda px: A.accumulate(px, "mod"), _MODE.format("v"))
add("accumulate_stack", "PS", lambda px: A.accumulate_many(px, ["sum", "avg", "min", "max", "std", "medv"]), "SELECT j, i, sum(v) AS sum, avg(v) AS avg, min(v) AS min, max(v) AS max, stddev_pop(v) AS std, median(v) AS medv FROM px GROUP BY 1, 2")

add("affine", "PV", lambda px: P.affine(px, 2.0, 1.0), "SELECT image_id, j, i, c, v * 2 + 1 AS v FROM px")
add("pixel_expr", "PV", lambda px: P.pixel_expr({"x": px, "y": P.successors(px)}, lambda x, y: x * y + F.abs(x - y), None), f", {NEXT} SELECT a.image_id, a.j, a.i, a.c, a.v * b.v + abs(a.v - b.v) AS v FROM px a JOIN n b ON a.image_id = b.image_id AND a.j = b.j AND a.i = b.i AND a.c = b.c")
_DIMS = "d AS (SELECT image_id, max(i) + 1 AS w, max(j) + 1 AS h FROM px GROUP BY 1)"
add("dims", "PV", P.dims, "SELECT image_id, max(i) + 1 AS w, max(j) + 1 AS h, max(c) + 1 AS pd, count(v) AS n FROM px GROUP BY 1")
add("shift_periodic", "PV", lambda px: P.shift(px, 3, -2, "periodic"), f", {_DIMS} SELECT p.image_id, p.j, p.i, p.c, q.v FROM px p JOIN d USING (image_id) LEFT JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.i = (p.i + 3) % d.w AND q.j = (p.j - 2 + d.h) % d.h")
add("where_mask", "PE", lambda px: P.where_mask(px, px.where("n > 3").withColumn("v", F.lit(1.0))), "SELECT image_id, j, i, c, v, n FROM px WHERE n > 3")
add("norm", "PV", lambda px: P.norm(px), "SELECT image_id, j, i, 0 AS c, sqrt(sum(v * v)) AS v FROM px GROUP BY 1, 2, 3")
add("columnize", "PL", lambda px: P.columnize(px, [0]), "SELECT image_id, j, i, max(v) AS v0 FROM px WHERE c = 0 GROUP BY 1, 2, 3 HAVING max(v) != 0")
add("crop", "PV", lambda px: P.crop(px, 4, 3, -4, 20), f", {_DIMS} SELECT image_id, j - 3 AS j, i - 4 AS i, c, v FROM px JOIN d USING (image_id) WHERE i >= 4 AND i < w - 4 AND j >= 3 AND j < 20")
add("flip_r90", "PV", lambda px: P.flip(px, "r90"), f", {_DIMS} SELECT image_id, w - 1 - i AS j, j AS i, c, v FROM px JOIN d USING (image_id)")
add("ntiply", "PL", lambda px: P.ntiply(px, 2), "SELECT image_id, j * 2 + a AS j, i * 2 + b AS i, c, v FROM px, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b)")
add("downsa_v", "PV", lambda px: P.downsa(px, 3, "v"), f", {_DIMS} SELECT image_id, j // 3 AS j, i // 3 AS i, c, avg(v) AS v FROM px JOIN d USING (image_id) WHERE (i // 3 + 1) * 3 <= w AND (j // 3 + 1) * 3 <= h GROUP BY 1, 2, 3, 4")
add("fftshift", "PV", P.fftshift, f", {_DIMS} SELECT image_id, (j + h // 2) % h AS j, (i + w // 2) % w AS i, c, v FROM px JOIN d USING (image_id)")
add("pyramid", "PV", lambda px: P.pyramid(px, 3), "SELECT image_id, j, i, c, v, 0 AS octave FROM px UNION ALL SELECT image_id, j // 2, i // 2, c, avg(v), 1 FROM px GROUP BY 1, 2, 3, 4 UNION ALL SELECT image_id, j // 2, i // 2, c, avg(v), 2 FROM (SELECT image_id, j // 2 AS j, i // 2 AS i, c, avg(v) AS v FROM px GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4")
add("fill_rows", "PE", lambda px: P.fill_rows(px, 24), """, g AS (SELECT image_id, j, c, i FROM (SELECT DISTINCT image_id, j, c FROM px), (SELECT CAST(unnest(generate_series(0, 23)) AS INT) AS i)),
    f AS (SELECT g.*, v FROM g LEFT JOIN px USING (image_id, j, i, c)),
    k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ai, last_value(v IGNORE NULLS) OVER a AS av, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS bi, first_value(v IGNORE NULLS) OVER b AS bv FROM f
        WINDOW a AS (PARTITION BY image_id, j, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY image_id, j, c ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT image_id, j, i, c, coalesce(v, av + (bv - av) * (i - ai) / (bi - ai), av, bv) AS v FROM k""")

add("histogram", "PU", S.histogram, "SELECT *, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY v) AS BIGINT) AS cum FROM (SELECT image_id, v, count(*) AS n FROM px GROUP BY 1, 2)")
add("percentile_nr", "PV", lambda px: S.percentile_nr(px, [5.0, 50.0, 95.0]), "SELECT image_id, " + ", ".join(f"list_sort(list(v))[CAST(floor((count(v) - 1) * {p / 100}) AS BIGINT) + 1] AS q{p}" for p in (5, 50, 95)) + " FROM px GROUP BY 1")
add("image_report", "PV", S.image_report, "SELECT image_id, c, count(v) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, sum(v) AS total, stddev_pop(v) AS sigma, sqrt(avg(v * v)) AS rms, avg(abs(v)) AS mean_abs, count(*) FILTER (WHERE v = 0) AS zeros, count(DISTINCT v) AS different FROM px GROUP BY GROUPING SETS ((image_id), (image_id, c))")
add("image_error", "PV", lambda px: S.image_error(px, P.affine(px, 0.9, 0.01)), "SELECT image_id, avg(e * e) AS mse, avg(abs(e)) AS mae, max(abs(e)) AS worst, corr(v, w) AS ncc, sqrt(avg(e * e)) AS rmse, 10 * log10(65025 / avg(e * e)) AS psnr FROM (SELECT image_id, v, v * 0.9 + 0.01 AS w, v - (v * 0.9 + 0.01) AS e FROM px) GROUP BY 1")
add("histo_mode", "PE", lambda px: S.histo_mode(px, 10.0), "SELECT image_id, arg_max(b, struct_pack(n := n, b := -b)) * 10 AS mode, max(n) AS n FROM (SELECT image_id, floor(v / 10 + 0.5) AS b, count(*) AS n FROM px GROUP BY 1, 2) GROUP BY 1")
add("posmax", "PV", S.posmax, "SELECT image_id, j, i, v FROM px QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, j, i) = 1")
add("hist2d", "PTS", lambda p: S.hist2d(p.withColumn("x", F.col("x") - 25).withColumn("y", F.col("y") / 100 - 10), 32, 0.5), "SELECT CAST(floor((x - 25) * 0.5 + 16) AS INT) AS i, CAST(floor((y / 100 - 10) * 0.5 + 16) AS INT) AS j, count(*) AS n FROM px WHERE floor((x - 25) * 0.5 + 16) BETWEEN 0 AND 31 AND floor((y / 100 - 10) * 0.5 + 16) BETWEEN 0 AND 31 GROUP BY 1, 2")
add("qeasy", "PV", lambda px: S.qeasy(px, -0.3, 0.3), "SELECT image_id, j, i, c, floor(greatest(0, least(255, 255 * (v - -0.3) / (0.3 - -0.3)))) AS v FROM px")
add("qauto", "PU", S.qauto, ", e AS (SELECT image_id, list_sort(list(v))[CAST(floor((count(v) - 1) * 0.05) AS BIGINT) + 1] AS lo, list_sort(list(v))[CAST(floor((count(v) - 1) * 0.95) AS BIGINT) + 1] AS hi FROM px GROUP BY 1) SELECT image_id, j, i, c, floor(greatest(0, least(255, CASE WHEN hi > lo THEN 255 * (v - lo) / (hi - lo) ELSE 127 END))) AS v FROM px JOIN e USING (image_id)")
add("histeq", "PU", S.histeq, ", e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), b AS (SELECT px.*, CAST(least(255, floor((v - lo) * 256 / (hi - lo))) AS INT) AS bin FROM px JOIN e USING (image_id)) SELECT image_id, j, i, c, (count(*) OVER (PARTITION BY image_id ORDER BY bin)) / (count(*) OVER (PARTITION BY image_id)) AS v FROM b")
add("colormatch", "PE", lambda px: S.colormatch(px, P.successors(px), each=True), f", {NEXT}, s AS (SELECT a.image_id, a.c, avg(a.v) AS ma, avg(b.v) AS mb, stddev_pop(a.v) AS sa, stddev_pop(b.v) AS sb FROM px a JOIN n b ON a.image_id = b.image_id AND a.j = b.j AND a.i = b.i AND a.c = b.c GROUP BY 1, 2) SELECT image_id, j, i, c, (v - ma) * (sb / sa) + mb AS v FROM px JOIN s USING (image_id, c)")

_NEAR = "FROM px p JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1"
for _name, _fn, _agg in (("erode", N.erode, "min"), ("dilate", N.dilate, "max"), ("median_filter", N.median_filter, "median")):
    add(f"{_name}_square", "PL", lambda px, fn=_fn: fn(px, N.element("square")), f"SELECT p.image_id, p.j, p.i, p.c, {_agg}(q.v) AS v {_NEAR} GROUP BY 1, 2, 3, 4")
for _op, _sql in (("gradient", "max(q.v) - min(q.v)"), ("laplacian", "(max(q.v) + min(q.v) - 2 * any_value(p.v)) / 2")):
    add(f"morph_{_op}", "PL", lambda px, op=_op: N.morph(px, N.element("cross"), op), f"SELECT p.image_id, p.j, p.i, p.c, {_sql} AS v {_NEAR} AND abs(q.i - p.i) + abs(q.j - p.j) <= 1 GROUP BY 1, 2, 3, 4")
add("opening_cross", "PL", lambda px: N.opening(px, N.element("cross")), f", e AS (SELECT p.image_id, p.j, p.i, p.c, min(q.v) AS v {_NEAR} AND abs(q.i - p.i) + abs(q.j - p.j) <= 1 GROUP BY 1, 2, 3, 4) SELECT p.image_id, p.j, p.i, p.c, max(q.v) AS v {_NEAR.replace('px', 'e')} AND abs(q.i - p.i) + abs(q.j - p.j) <= 1 GROUP BY 1, 2, 3, 4")
add("convolve", "PE", lambda px: N.convolve(px, {(x, y): (2 - abs(x)) * (2 - abs(y)) for x in (-1, 0, 1) for y in (-1, 0, 1)}), f"SELECT p.image_id, p.j, p.i, p.c, sum(q.v * w) / sum(w) AS v FROM (SELECT p.image_id, p.j, p.i, p.c, q.v, (2 - abs(q.i - p.i)) * (2 - abs(q.j - p.j)) AS w {_NEAR}) p, (SELECT 1) q GROUP BY 1, 2, 3, 4".replace("sum(q.v * w)", "sum(v * w)"))
add("error_norm_3", "PV", lambda px: S.error_norm(px, 3, P.affine(px, 0.9, 0.01)), "SELECT image_id, pow(avg(pow(abs(v - (v * 0.9 + 0.01)), 3)), 1.0 / 3) AS error FROM px GROUP BY 1")
add("error_norm_alone", "PV", lambda px: S.error_norm(px, 1), "SELECT image_id, avg(abs(v)) AS error FROM px GROUP BY 1")
_PAIR = "o AS (SELECT p.image_id, p.j, p.i, p.c, p.v AS x, n.v AS y FROM px p JOIN n USING (image_id, j, i, c) WHERE p.v IS NOT NULL AND n.v IS NOT NULL)"
add("similarity", "PV", lambda px: S.similarity(px, P.successors(px), 2, 1.0), f", {NEXT}, {_PAIR}, m AS (SELECT p.image_id, p.j, p.i, p.c, avg(q.x) AS mx, avg(q.y) AS my, var_pop(q.x) AS vx, var_pop(q.y) AS vy, covar_pop(q.x, q.y) AS vxy FROM o p JOIN o q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) <= 2 AND abs(q.j - p.j) <= 2 GROUP BY 1, 2, 3, 4) SELECT image_id, avg((2 * mx * my + 0.0001) * (2 * vxy + 0.0009) / ((mx * mx + my * my + 0.0001) * (vx + vy + 0.0009))) AS ssim, avg(CASE WHEN vx + vy > 1e-12 * (mx * mx + my * my) THEN 4 * mx * my * vxy / ((mx * mx + my * my) * (vx + vy)) END) AS uiqi FROM m GROUP BY 1")
add("box_mean", "PV", lambda px: N.box_mean(px, 2), "SELECT p.image_id, p.j, p.i, p.c, avg(q.v) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) <= 2 AND abs(q.j - p.j) <= 2 GROUP BY 1, 2, 3, 4")
add("integral", "PL", N.integral, "SELECT p.image_id, p.j, p.i, p.c, sum(q.v) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.i <= p.i AND q.j <= p.j GROUP BY 1, 2, 3, 4")
add("local_extrema", "PV", N.local_extrema, f"SELECT p.image_id, p.j, p.i, p.c, CASE WHEN any_value(p.v) > 0 AND any_value(p.v) > max(q.v) OR any_value(p.v) < 0 AND any_value(p.v) < min(q.v) THEN any_value(p.v) ELSE 0 END AS v {_NEAR} AND (q.i != p.i OR q.j != p.j) GROUP BY 1, 2, 3, 4")
add("running_median", "TS", lambda s: N.running_median(s, 5, "event_type", "t"), "SELECT *, median(v) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM px")

add("rasterize", "LI", lambda p: T.rasterize(p, 0.0, 51.0, 0.0, 105.0, 50, 40), "SELECT CAST(greatest(0, least(39, floor(y * 40 / 105))) AS INT) AS j, CAST(greatest(0, least(49, floor(x * 50 / 51))) AS INT) AS i, avg(z) AS mean, min(z) AS lo, max(z) AS hi, count(z) AS n FROM px GROUP BY 1, 2")
add("map_points", "PTS", lambda p: T.map_points(p, [1, 0.5, 3, 0, 2, -1, 0, 0.001, 1]), "SELECT id, (x + 0.5 * y + 3) / (0.001 * y + 1) AS x, (2 * y - 1) / (0.001 * y + 1) AS y FROM px")
add("segments_longer", "SEG", lambda s: T.segments_longer(s, 25.0), "SELECT * FROM px WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) > 25")
add("match_window", "KP", lambda k: T.match_window(k.where("side = 'a'"), k.where("side = 'b'"), 5.0, 5.0, 2.0), 'SELECT "from", "to", d FROM (SELECT a.id AS "from", b.id AS "to", list_distance(CAST(a.descr AS DOUBLE[]), CAST(b.descr AS DOUBLE[])) AS d FROM px a, px b WHERE a.side = \'a\' AND b.side = \'b\' AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5) WHERE d < 2 QUALIFY row_number() OVER (PARTITION BY "from" ORDER BY d, "to") = 1')
add("track_points", "KP", lambda k: T.track_points(k.where("side = 'a'"), k.where("side = 'b'"), 3.0), 'SELECT "from", "to", d FROM (SELECT a.id AS "from", b.id AS "to", sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM px a, px b WHERE a.side = \'a\' AND b.side = \'b\' AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3) WHERE d <= 3 QUALIFY row_number() OVER (PARTITION BY "from" ORDER BY d, "to") = 1')
