import math

import numpy as np
import pytest

from gridweave.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}
    pairs = [(a, b) for n, (a, x) in enumerate(ok) for b, y in ok[n + 1 :] if len(x) == len(y) and a != b and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(20):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {(i, links[i], root[i]) for i, _ in rows}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_brute(spark, monkeypatch, kind):
    monkeypatch.setattr(E, "CHUNK", 20)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.standard_normal(32).tolist()) for i in rng.permutation(400)]
    for k, n in enumerate((60, 20, 3, 2, 2)):
        base = np.array(rows[k][1])
        rows += [(1000 * (k + 1) + i, (base + rng.standard_normal(32) * 0.2 * rng.random()).tolist()) for i in range(n)]
    rows += [(9000, rows[0][1]), (9001, rows[0][1]), (9002, [2 * x for x in rows[0][1]]), (9003, None), (9004, [0.0] * 32), (9005, [float("nan")] + [1.0] * 31), (9006, [None] + [1.0] * 31), (9007, []), (9008, [1.0, 2.0]), (9009, [2.0, 4.0]), (9010, [float("inf")] * 32)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows] + [(None, rows[0][1], 3)], f"vec_id long, embedding array<{kind}>, node int").repartition(3)
    got = E.link_vectors(df).collect()
    want = brute([(i, None if v is None else [None if x is None else float(np.dtype("f4").type(x)) if kind == "float" else x for x in v]) for i, v in rows])
    have = {(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None}
    assert len(got) == len(rows) + 1
    total = sum(n for _, n, _ in want)
    assert total * 0.97 <= sum(n for _, n, _ in have) <= total
    assert len(want & have) >= 0.97 * len(want)


def test_calibration():
    rng = np.random.default_rng(2)
    width, tables, enough = E.calibrate(5000, 0.9, 0.96)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = (E.cell_keys(x, width, tables) == E.cell_keys(y, width, tables)).any(1).mean()
    assert met > 0.93
    a = E._directions(64, E.COUNTED, 2)
    assert ((np.abs(x @ a - y @ a) <= E.WINDOW).sum(1) >= enough).mean() > 0.998


def test_empty(spark):
    assert E.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
