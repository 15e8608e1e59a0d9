"""Registered queries over warps, fields, transforms and pairs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import fields as D
from gridweave.operators import pairs as R
from gridweave.operators import transforms as X
from gridweave.operators import warps as W
from gridweave.operators import neighbours as N
from gridweave.operators.neighbours import element
from gridweave.operators import pixels as P
from gridweave.plans.registry import NEXT, add

_DIMS = "d AS (SELECT image_id, max(i) + 1 AS w, max(j) + 1 AS h FROM px GROUP BY 1)"
_GRID = "g AS (SELECT image_id, c, j, i FROM (SELECT DISTINCT image_id, c FROM px), (SELECT CAST(unnest(generate_series(0, {h})) AS INT) AS j), (SELECT CAST(unnest(generate_series(0, {w})) AS INT) AS i))"
_NEAR = "FROM px p JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) <= 1 AND abs(q.j - p.j) <= 1"
_H = [0.9, 0.1, 0.5, -0.05, 0.8, 1.0, 0.001, 0.0, 1.0]
_XY = ", " + _GRID.format(h=31, w=15) + ", s AS (SELECT *, (0.9 * i + 0.1 * j + 0.5) / (0.001 * i + 0.0 * j + 1.0) AS x, (-0.05 * i + 0.8 * j + 1.0) / (0.001 * i + 0.0 * j + 1.0) AS y FROM g)"

add("homwarp_nearest", "PL", lambda px: W.homwarp(px, _H, 16, 32, 0), f"{_XY} SELECT s.image_id, s.j, s.i, s.c, px.v FROM s LEFT JOIN px ON px.image_id = s.image_id AND px.c = s.c AND px.i = floor(x + 0.5) AND px.j = floor(y + 0.5)")
add("homwarp_bilinear", "PL", lambda px: W.homwarp(px, _H, 16, 32), f"""{_XY}, k AS (SELECT s.*, floor(x) + a AS si, floor(y) + b AS sj, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS wt FROM s, (VALUES (0), (1)) m(a), (VALUES (0), (1)) n(b))
    SELECT k.image_id, k.j, k.i, k.c, CASE WHEN count(px.v) = count(*) THEN sum(wt * px.v) END AS v FROM k LEFT JOIN px ON px.image_id = k.image_id AND px.c = k.c AND px.i = si AND px.j = sj WHERE wt > 0 GROUP BY 1, 2, 3, 4""")
add("upsa_bilinear", "PL", lambda px: W.upsa(px, 2), "SELECT p.image_id, p.j * 2 + s AS j, p.i * 2 + t AS i, p.c, (1 - s / 2) * ((1 - t / 2) * p.v + t / 2 * r.v) + s / 2 * ((1 - t / 2) * b.v + t / 2 * q.v) AS v FROM px p JOIN px r ON r.image_id = p.image_id AND r.c = p.c AND r.j = p.j AND r.i = p.i + 1 JOIN px b ON b.image_id = p.image_id AND b.c = p.c AND b.j = p.j + 1 AND b.i = p.i JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND q.j = p.j + 1 AND q.i = p.i + 1, (VALUES (0), (1)) m(s), (VALUES (0), (1)) n(t)")
add("zeropad", "PE", lambda px: W.zeropad(px, 24, 31), f", {_GRID.format(h=30, w=23)} SELECT g.image_id, g.j, g.i, g.c, coalesce(px.v, 0) AS v FROM g LEFT JOIN px USING (image_id, j, i, c)")
add("periodize", "PL", W.periodize, f", {_DIMS} SELECT image_id, CASE s WHEN 0 THEN j ELSE 2 * h - 1 - j END AS j, CASE t WHEN 0 THEN i ELSE 2 * w - 1 - i END AS i, c, v FROM px JOIN d USING (image_id), (VALUES (0), (1)) m(s), (VALUES (0), (1)) n(t)")
add("replicate", "PL", W.replicate, f", {_DIMS} SELECT image_id, j + s * h AS j, i + t * w AS i, c, v FROM px JOIN d USING (image_id), (VALUES (0), (1)) m(s), (VALUES (0), (1)) n(t)")
add("redim", "PL", lambda px: W.redim(px, 20), f", {_DIMS} SELECT image_id, (j * w + i) // 20 AS j, (j * w + i) % 20 AS i, c, v FROM px JOIN d USING (image_id)")
add("imhalve", "PV", W.imhalve, f", {_DIMS} SELECT image_id, j, i, c, v FROM px JOIN d USING (image_id) WHERE i < w // 2 AND j < h // 2")
add("tbcat", "PL", lambda px: W.tbcat(px, P.successors(px), None), f", {NEXT} SELECT image_id, j, i, c, v FROM px UNION ALL SELECT image_id, j + (SELECT max(q.j) + 1 FROM px q WHERE q.image_id = n.image_id), i, c, v FROM n")

add("rank_filter", "PL", lambda px: N.rank_filter(px, element("square")), f"SELECT p.image_id, p.j, p.i, p.c, CAST(count(*) FILTER (WHERE q.v < p.v) AS DOUBLE) AS v {_NEAR} GROUP BY 1, 2, 3, 4")
_FLOW = "{b} AS (SELECT p.image_id, p.j, p.i, p.c, any_value(p.v) + 0.2 * sum(q.v - p.v) AS v " + _NEAR.replace("px", "{a}") + " AND abs(q.i - p.i) + abs(q.j - p.j) <= 1 GROUP BY 1, 2, 3, 4)"
add("diffuse", "PE", lambda px: D.diffuse(px, 0.2, 4), ", " + ", ".join(_FLOW.format(a=a, b=b) for a, b in zip(("px", "d1", "d2", "d3"), ("d1", "d2", "d3", "d4"))) + " SELECT * FROM d4")
add("sphere_count", "PE", lambda px: D.sphere_count(px, 2.5, 10.0), "SELECT p.image_id, p.j, p.i, p.c, CAST(count(*) FILTER (WHERE (q.i - p.i) * (q.i - p.i) + (q.j - p.j) * (q.j - p.j) + pow((q.v - p.v) / 10, 2) < 6.25) AS DOUBLE) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.c = p.c AND abs(q.i - p.i) <= 2 AND abs(q.j - p.j) <= 2 GROUP BY 1, 2, 3, 4")
_SIDES = ", e AS (SELECT p.image_id, p.j, p.i, p.c, p.v, (coalesce(r.v, p.v) - coalesce(l.v, p.v)) / 2 AS gx, (coalesce(b.v, p.v) - coalesce(a.v, p.v)) / 2 AS gy FROM px p " + " ".join(f"LEFT JOIN px {n} ON {n}.image_id = p.image_id AND {n}.c = p.c AND {n}.i = p.i + {x} AND {n}.j = p.j + {y}" for n, x, y in (("r", 1, 0), ("l", -1, 0), ("b", 0, 1), ("a", 0, -1))) + ")"
add("gradient", "PE", D.gradient, f"{_SIDES} SELECT * FROM e")
add("monodisp", "PL", D.monodisp, "SELECT image_id, j, i, c, v FROM (SELECT *, lag(v) OVER (PARTITION BY image_id, j, c ORDER BY i) AS u FROM px) WHERE u IS NULL OR v > u - 1")
add("fill_nearest", "PE", lambda px: D.fill_nearest(px, 24, 30), f", {_GRID.format(h=29, w=23)} SELECT g.image_id, g.j, g.i, g.c, arg_min(px.v, struct_pack(d := (px.i - g.i) * (px.i - g.i) + (px.j - g.j) * (px.j - g.j), j := px.j, i := px.i)) AS v FROM g JOIN px ON px.image_id = g.image_id AND px.c = g.c GROUP BY 1, 2, 3, 4")
add("distance", "PE", lambda px: D.distance(px.where("n > 5"), 24, 30), f", m AS (SELECT * FROM px WHERE n > 5 AND v != 0), {_GRID.format(h=29, w=23).replace('FROM px', 'FROM m')} SELECT g.image_id, g.j, g.i, g.c, sqrt(min((m.i - g.i) * (m.i - g.i) + (m.j - g.j) * (m.j - g.j))) AS v FROM g JOIN m ON m.image_id = g.image_id AND m.c = g.c GROUP BY 1, 2, 3, 4")

add("dft2", "PL", X.dft2, f", {_DIMS}, r AS (SELECT image_id, w, h, j, k, sum(v * cos(2 * pi() * k * i / w)) AS re, -sum(v * sin(2 * pi() * k * i / w)) AS im FROM px JOIN d USING (image_id), (SELECT CAST(unnest(generate_series(0, 15)) AS INT) AS k) WHERE k < w GROUP BY 1, 2, 3, 4, 5), z AS (SELECT image_id, l AS j, k AS i, sum(re * cos(2 * pi() * l * j / h) + im * sin(2 * pi() * l * j / h)) AS re, sum(im * cos(2 * pi() * l * j / h) - re * sin(2 * pi() * l * j / h)) AS im FROM r, (SELECT CAST(unnest(generate_series(0, 31)) AS INT) AS l) WHERE l < h GROUP BY 1, 2, 3) SELECT image_id, j, i, 0 AS c, re AS v FROM z UNION ALL SELECT image_id, j, i, 1, im FROM z")
add("hough", "PE", lambda px: X.hough(px, 36, 40, 40.0, 50.0), "SELECT image_id, t, r, sum(v) AS v FROM (SELECT image_id, t, CAST(floor((i * cos(t * (pi() / 36)) + j * sin(t * (pi() / 36)) + 40) * 40 / 80) AS INT) AS r, v FROM px, (SELECT CAST(unnest(generate_series(0, 35)) AS INT) AS t) WHERE v > 50) WHERE r BETWEEN 0 AND 39 GROUP BY 1, 2, 3")
add("displacement_costs", "PL", lambda px: X.displacement_costs(px, P.successors(px), [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)], each=True), f", {NEXT} SELECT a.image_id, dx, dy, avg((a.v - b.v) * (a.v - b.v)) AS cost, count(*) AS n FROM px a JOIN n b USING (image_id, c), (VALUES (-1), (0), (1)) m(dx), (VALUES (-1), (0), (1)) o(dy) WHERE b.i = a.i + dx AND b.j = a.j + dy GROUP BY 1, 2, 3")

add("point_raster", "PTS", lambda p: R.point_raster(p.withColumn("y", F.col("y") / 50), 40, 40), "SELECT CAST(floor(y / 50 + 0.5) AS INT) AS j, CAST(floor(x + 0.5) AS INT) AS i, count(*) AS n FROM px WHERE floor(y / 50 + 0.5) BETWEEN 0 AND 39 AND floor(x + 0.5) BETWEEN 0 AND 39 GROUP BY 1, 2")
add("pairs_to_image", "SEG", R.pairs_to_image, "SELECT CAST(floor(y1 + 0.5) AS INT) AS j, CAST(floor(x1 + 0.5) AS INT) AS i, avg(x2 - x1) AS dx, avg(y2 - y1) AS dy FROM px GROUP BY 1, 2")
add("match_error", "SEG", lambda s: R.match_error(s, [1, 0.5, 3, 0, 2, -1, 0, 0.001, 1]), "SELECT *, sqrt(pow((x1 + 0.5 * y1 + 3) / (0.001 * y1 + 1) - x2, 2) + pow((2 * y1 - 1) / (0.001 * y1 + 1) - y2, 2)) AS error FROM px")
add("split_points", "PTS", lambda p: R.split_points(p.withColumn("y", F.col("y") / 50), 10.0, 4.0), "SELECT id, x, y / 50 AS y, ti, tj FROM px, (SELECT CAST(unnest(generate_series(-1, 20)) AS INT) AS ti), (SELECT CAST(unnest(generate_series(-1, 20)) AS INT) AS tj) WHERE x >= ti * 6.0 AND x < ti * 6.0 + 10 AND y / 50 >= tj * 6.0 AND y / 50 < tj * 6.0 + 10")
add("extreme_vector", "PS", lambda px: R.extreme_vector(px.selectExpr("image_id", "j", "0 AS i", "i AS c", "v")), "SELECT j, 0 AS i, i AS c, v FROM px JOIN (SELECT j, arg_min(image_id, struct_pack(s := -s, k := image_id)) AS image_id FROM (SELECT image_id, j, sum(v * v) AS s FROM px GROUP BY 1, 2) GROUP BY 1) USING (j, image_id)")
