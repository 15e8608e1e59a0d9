"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Unit vectors are projected on many random directions. A pair at the wanted cosine lies within a window
around the query on nearly all of them, a pair at random on half. Counting that for all pairs would
be quadratic, so a pair is counted only if it shares a cell of one of several tables, each cutting a few of
the sorted projections into windows of width ``WIDTH``. How many projections a table takes follows
from the number of vectors (about one chance meeting for each vector and table), and how many tables from the
recall wanted at the threshold, both by formula. Pairs in a cell then need ``MIN_COUNT`` of ``COUNTED`` window
collisions (all but 1e-4 of the wanted pairs have them), and those are verified by cosine in double
precision.

Equal vectors are one node with a weight. A cell above ``CHUNK`` nodes is cut into chunks by hash and its pairs
of chunks are dealt out, so no task holds more than two chunks. A pair is counted in the first table in which it
meets; tasks return sums for each node and local components, never pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor do
rows without vec_id; vectors of different lengths never link; equal rows of one vec_id count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import materialise, unused_name
from gridweave.operators.graph import connected

WIDTH, CHUNK, COUNTED = 2.0, 2000, 48
#: Half of the query-centred window, in units of the projections' spread over unit vectors.
WINDOW = 0.8
PAIRS_AT_ONCE = 1 << 19


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at this distance share a cell of one projection cut at a random offset."""
    x = width / distance
    return 2 * NormalDist().cdf(x) - 1 - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def calibrate(n: int, cosine: float, recall: float) -> tuple[int, int, int]:
    """Projections for each table, tables, and the least count of window collisions."""
    near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2)
    width = max(2, math.ceil(math.log(max(n, 2)) / -math.log(same_cell(far))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same_cell(near) ** width))
    p = 2 * NormalDist().cdf(WINDOW / near) - 1
    below, k = 0.0, 0
    while (below := below + math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)) < 1e-4:
        k += 1
    return width, tables, k


def _directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def cell_keys(unit: np.ndarray, width: int, tables: int) -> np.ndarray:
    """A 64-bit cell for each row and table."""
    offsets = np.random.default_rng(7).uniform(0, WIDTH, width * tables)
    cells = np.floor((unit @ _directions(unit.shape[1], width * tables, 1) + offsets) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, width)
    key = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for k in range(width):
        key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(float)
    v /= np.abs(v).max(1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each component of the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.96, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    kind, name = ("<f4", "float") if "float" in dict(vectors.dtypes)[embedding] else ("<f8", "double")
    own = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast(f"array<{name}>").alias("v"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [(np.asarray(v, kind) + 0).tobytes() if ok else None for v, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["vec_id", "packed"])

    rows = materialise(own.withColumn("ok", F.coalesce(sound, F.lit(False))).mapInArrow(pack, "vec_id bigint, packed binary"))
    nodes = rows.where("packed is not null").distinct().groupBy("packed").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    nodes = materialise(nodes.withColumn("node", F.unhex(F.sha2("packed", 256))))
    width, tables, enough = calibrate(nodes.count(), cosine, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for size in {len(p) for p in packed}:
                at = [k for k, p in enumerate(packed) if len(p) == size]
                for lo in range(0, len(at), 512):
                    some = at[lo : lo + 512]
                    keys = cell_keys(_unit([packed[k] for k in some], kind), width, tables)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some for _ in range(tables)], pa.binary()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))), pa.array(keys.ravel())], names=["node", "t", "cell"])

    entries = materialise(nodes.select("node", "packed").mapInArrow(sign, "node binary, t int, cell bigint"))
    full = entries.groupBy("t", "cell").agg(F.count("*").alias("n")).where("n > 1").select("t", "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = entries.join(full, ["t", "cell"]).withColumn("c", F.pmod(F.xxhash64("node", "t"), "chunks").cast("int"))
    dealt = dealt.select("node", "t", "cell", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"))
    dealt = dealt.select("node", "t", "cell", "c", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"))
    group = ["t", "cell", "lo", "hi"]
    dealt = dealt.join(nodes.select("node", "packed", "weight"), "node").repartition(*group).sortWithinPartitions(*group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole groups, in order."""
            n = len(block)
            if n < 2:
                return
            t, chunk = (block.column(c).to_numpy() for c in ("t", "c"))
            keys = np.stack([block.column(c).to_numpy() for c in group])
            new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
            end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
            after = end - np.arange(n) - 1
            cross = keys[2] != keys[3]
            names, packed, weight = block.column("node").to_pylist(), block.column("packed").to_pylist(), block.column("weight").to_numpy()
            used = np.flatnonzero((after > 0) | ~new)
            if not len(used):
                return
            unit, shadow = np.zeros((n, 0)), None
            by_size: dict[int, list[int]] = {}
            for k in used.tolist():
                by_size.setdefault(len(packed[k]), []).append(k)
            for size, at in by_size.items():  # vectors of one length at a time; cells hold no others but by chance
                unit = np.zeros((n, size // np.dtype(kind).itemsize))
                unit[at] = _unit([packed[k] for k in at], kind)
                has = np.zeros(n, bool)
                has[at] = True
                shadow = unit @ _directions(unit.shape[1], COUNTED, 2)
                reach = np.cumsum(after)
                lo, good_i, good_j = 0, [], []
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
                    some = after[lo:hi]
                    i = np.repeat(np.arange(lo, hi), some)
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
                    ok = has[i] & has[j] & (~cross[i] | (chunk[i] != chunk[j]))
                    i, j = i[ok], j[ok]
                    met = np.zeros(len(i), np.int16)
                    for p in shadow.T:
                        met += np.abs(p[i] - p[j]) <= WINDOW
                    i, j = i[met >= enough], j[met >= enough]
                    close = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                    good_i.append(i[close])
                    good_j.append(j[close])
                    lo = hi
                i, j = np.concatenate(good_i), np.concatenate(good_j)
                if not len(i):
                    continue
                rows_, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                cells = cell_keys(unit[rows_], width, tables)
                a, b = back[: len(i)], back[len(i) :]
                first = np.concatenate([(cells[a[k : k + 4096]] == cells[b[k : k + 4096]]).argmax(1) for k in range(0, len(a), 4096)]) == t[i]
                a, b = a[first], b[first]
                links = np.zeros(len(rows_), np.int64)
                np.add.at(links, a, weight[rows_[b]])
                np.add.at(links, b, weight[rows_[a]])
                root = _roots(len(rows_), a, b)
                yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in rows_], pa.binary()), pa.array(links), pa.array([names[rows_[r]] for r in root], pa.binary())], names=["node", "links", "root"])

        held: pa.Table | None = None
        for batch in batches:
            block = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([block.column(c).to_numpy() for c in group])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
            cut = int(new[-1]) + 1 if len(new) else 0
            yield from done(block.slice(0, cut).combine_chunks())
            held = block.slice(cut)
        if held is not None:
            yield from done(held.combine_chunks())

    found = materialise(dealt.mapInArrow(count, "node binary, links bigint, root binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "n2")
    known = nodes.join(links, "node", "left").join(roots, F.col("node") == F.col("n2"), "left").withColumn("root", F.coalesce("root", "node"))
    known = known.select("packed", "least", "root", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least, "root").select("packed", "n", "component")
    out = rows.join(known, "packed", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
