"""Best-fit packing of pieces into sequences through the configuration linear program.

Only the histogram of lengths matters, which has at most ``capacity`` entries at any input size. A
configuration says how many pieces of each length share a sequence. The linear program (fewest
sequences whose configurations cover the histogram) is solved by multiplicative weights: lengths that
are behind get dearer, a knapsack by dynamic programming prices all configurations at once, the
best one through each length takes a small step. Every configuration of the solution, full or not, is
rounded down. Remainders are packed best-fit, into the room of sequences that aren't full first, by counts of a length
and of like sequences: the driver's work depends on the capacity, not on the pieces. The solution is rounded in several
ways (``ROUNDINGS``): a share of it is kept, full configurations that what is left still makes are added or not, small
pieces are taken out of it and left to the remainders or not. The way with the fewest sequences counts, the one that
keeps most of the solution if several have.

Pieces are then matched with places by their rank among the pieces of their length. Ranks are counted
by the tasks that make the pieces and joined with sums of earlier tasks' counts, so no length, however
common, meets in one task.

Edge cases: texts of any length are cut whole; a piece of null, zero or negative length, or longer than the capacity, raises ValueError
(``cut`` makes none); no pieces give no sequences; ties are broken by length; repeated rows are packed each; columns that
have a name of this operator raise ValueError. For ``cut``: null text counts as empty and gives one piece, the end id.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.llm.common import halved, materialise
from gridweave.llm.token_files import library_encoder

ROUNDS = 48
#: Share of the solution that is kept, least piece in it as a share of the capacity, whether full configurations are added.
ROUNDINGS = [(1, 0, True), (1, 0, False), (1, 1 / 4, True), (1, 1 / 3, True), (1, 1 / 3, False), *((1 / n, least, False) for n in (2, 4, 8, 16) for least in (0, 1 / 3))]
EPSILON = 0.08


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price within each capacity and the length index that it takes last (-1: one token stays free)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := upto[c]:
            got = value[c - lengths[:k]] + prices[:k]
            best = int(got.argmax())
            if got[best] > value[c]:
                value[c], last[c] = got[best], best
    return value, last


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations (pairs of length index and multiplicity) with weights that cover the counts but for remainders."""
    n = counts.astype(float)
    cover, behind = np.zeros(len(n)), np.zeros(len(n))
    weight: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-behind)
        value, last = knapsack(lengths, prices, capacity)
        through = prices + value[capacity - lengths]
        moved = np.zeros(len(n))
        for i in np.flatnonzero(through >= (1 - EPSILON) * value[capacity]):
            have, c = Counter({int(i): 1}), capacity - int(lengths[i])
            while c > 0:
                if last[c] < 0:
                    c -= 1
                else:
                    have[int(last[c])] += 1
                    c -= int(lengths[last[c]])
            step = min(max(0.0, n[j] * 2 / rounds - moved[j]) / m for j, m in have.items())
            if step > 0:
                weight[tuple(sorted(have.items()))] += step
                for j, m in have.items():
                    moved[j] += step * m
        cover += moved
        behind = (cover / n - (cover / n).min()) * 0.5
    return weight


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Configurations with whole multiplicities that use each piece exactly once."""
    full = lambda p: sum(int(lengths[j]) * m for j, m in p) / capacity
    solved, best, fewest = fractional(lengths, counts, capacity), [], None
    for share, least, add in ROUNDINGS:
        large: dict[tuple, float] = defaultdict(float)
        for p, x in solved.items():
            large[tuple((j, m) for j, m in p if lengths[j] >= least * capacity)] += x * share
        large.pop((), None)
        ranked = sorted(large.items(), key=lambda a: (-full(a[0]), -a[1], a[0]))
        left, out = counts.astype(np.int64).copy(), []
        for once in (False, True) if add else (False,):
            for p, x in ranked:
                k = min(int(left[j]) // m for j, m in p)
                k = min(k, int(x)) if not once else k if full(p) == 1 else 0
                if k > 0:
                    out.append((p, k))
                    for j, m in p:
                        left[j] -= k * m
        found = best_fit(lengths, left, capacity, out)
        size = sum(k for _, k in found)
        if fewest is None or size < fewest:
            best, fewest = found, size
    return best


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int, begun: list[tuple[tuple, int]] = ()) -> list[tuple[tuple, int]]:
    """Best fit in descending order for what rounding leaves, into ``begun`` sequences and new ones; a step for each length and kind of sequence."""
    room: list[Counter] = [Counter() for _ in range(capacity + 1)]
    open_ = 0

    def put(have: tuple, free: int, k: int) -> None:
        nonlocal open_
        if k:
            room[free][have] += k
            if free:
                open_ |= 1 << free

    for p, k in begun:
        put(tuple(sorted(p)), capacity - sum(int(lengths[j]) * m for j, m in p), k)
    for i in np.argsort(-lengths, kind="stable"):
        size, k = int(lengths[i]), int(left[i])
        while k:
            fit = open_ >> size
            if fit:
                free = size + (fit & -fit).bit_length() - 1
                have, n = room[free].popitem()
                if not room[free]:
                    open_ &= ~(1 << free)
            else:
                have, free, n = (), capacity, k
            # the tightest sequence stays so until no more of this length fit
            most = free // size
            whole = min(n, k // most)
            last = k - whole * most if whole < n else 0
            for m, times in ((most, whole), (last, int(last > 0))):
                held = Counter(dict(have))
                held[int(i)] += m
                put(tuple(sorted(held.items())), free - m * size, times)
            if have:
                put(have, free, n - whole - (last > 0))
            k -= whole * most + last
    done: Counter = Counter()
    for r in room:
        done.update(r)
    return sorted(done.items())


def places(lengths: np.ndarray, configurations: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces of the length in each, offset of the first)."""
    out: dict[int, list] = defaultdict(list)
    seen, sequence = Counter(), 0
    for p, k in configurations:
        offset = 0
        for j, m in sorted(p, reverse=True):
            size = int(lengths[j])
            out[size].append((seen[j], sequence, m, offset))
            seen[j] += k * m
            offset += size * m
        sequence += k
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to each row of ``pieces``; other columns pass through."""
    clash = {"sequence_id", "offset", "part_", "rank_", "before_"} & {c.lower() for c in pieces.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            size = batch.column(length)
            if size.null_count or len(size) and not 0 < pc.min(size).as_py() <= pc.max(size).as_py() <= capacity:
                raise ValueError(f"a length is not within 1 and {capacity}")
            size = size.to_numpy(zero_copy_only=False)
            order = np.argsort(size, kind="stable")
            first = np.searchsorted(size[order], size[order])
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first + seen[size[order]]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part), pa.int32()), pa.array(rank)], names=[*batch.schema.names, "part_", "rank_"])

    pieces = materialise(pieces)  # else each task holds one more Python worker, with the memos of what made the pieces
    ranked = materialise(pieces.mapInArrow(count, f"{fields}, part_ int, rank_ bigint"))
    by_part = ranked.groupBy("part_", length).agg(F.count("*").alias("n_"))
    histogram = by_part.groupBy(length).agg(F.sum("n_").alias("n_")).orderBy(length).collect()  # at most ``capacity`` rows
    sizes = np.array([r[0] for r in histogram], np.int64)
    counts = np.array([r[1] for r in histogram], np.int64)
    table = places(sizes, rounded(sizes, counts, capacity)) if len(sizes) else {}
    before = by_part.select("part_", length, (F.sum("n_").over(Window.partitionBy(length).orderBy("part_")) - F.col("n_")).alias("before_"))
    # its size depends on the capacity alone: configurations are at most ROUNDS * capacity and a few for each length of their remainders
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False)
            rank = batch.column("rank_").to_numpy(zero_copy_only=False) + batch.column("before_").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                own, rows = size == s, shared.value[int(s)]
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                within = rank[own] - at[:, 0]
                sequence[own] = at[:, 1] + within // at[:, 2]
                offset[own] = at[:, 3] + within % at[:, 2] * s
            keep = [c for c in batch.schema.names if c not in ("part_", "rank_", "before_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    joined = ranked.join(before, ["part_", length]).select(*ranked.columns, "before_")
    return joined.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise each text (null: empty), append ``end_id``, and cut what is longer than ``capacity``.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32 and, on request, ids (packed).
    """
    import zlib

    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary, False)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, flat, at in encoder.slices(batch.column(1), end_id):
                names, pieces, ids = [], [], []
                packed, bounds = flat.tobytes(), (4 * at).tolist()
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]), first):
                    for n, at_ in enumerate(range(lo, hi, step)):
                        names.append(doc_ids[k])
                        pieces.append(n)
                        ids.append(packed[at_ : min(hi, at_ + step)])
                piece = np.array(pieces, np.int32)
                columns = [pa.array(names, pa.int64()), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array([len(p) // 4 for p in ids], pa.int64()), pa.array([zlib.crc32(p) for p in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(halved(run, lambda: library_encoder(vocabulary, False).memos), schema)
