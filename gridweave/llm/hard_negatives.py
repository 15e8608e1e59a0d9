"""Hard negatives for anchors by the BOND vertical scan.

Vectors are scored by the integer inner product of their quantised components. A block of rows is held as columns, one
for each dimension, with its least and greatest component. An anchor reads the columns in descending order of its own
magnitudes, a few at a time; what the columns not yet read can add lies between sums of products with these extrema, so
each row has a lower and an upper bound of its score, and the bitmap of candidates shrinks as bounds close.

Positives, the nearest rows of the anchor's label, come first: a row goes when its upper bound is below the k-th best
lower one, here or among rows the task has seen before. Then each positive's score opens a window of scores; a row of
another label goes when it can't be in any window, or not among the k best of one. What is left has been read in full, so
the scores are exact and bounds only save work. Rows that tie stay to the end, and ids decide.

Rows are dealt by a hash of their ids to groups, anchors in the same way, and each group of rows meets each group of
anchors in a task that reads both as a stream; a group's size is an expectation that doesn't grow with the data. So anchors
are a stated set that is compared with all rows in blocks. Each block returns its k best for each anchor and window, and
those are ranked again. Nothing is broadcast or collected but two counts.

Edge cases: rows with a null id or label, a null vector or a null or non-finite component take no part; of rows with
one id the one with the least label and vector counts; shorter vectors count as 0 where they have no component; ties in
scores go to the smaller id; a component beyond 32 bits once quantised is an error; an empty table, and one without
anchors, give no rows; other columns aren't read, whatever their names. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.llm.common import discard, materialise, tidy

#: Rows and anchors that a group is expected to have.
ROWS, ANCHORS = 8192, 8192
#: Columns read between two looks at the bounds.
STEP = 8


def quantised(rows: DataFrame, scale: int = 256, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """vec_id, label, q: floor(scale * component) of the rows that take part, one for each id."""
    v = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    v = v.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))
    return v.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")


class Columns:
    """A block of rows, dimension by dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, bound: float):
        exact = bound < 2**53  # sums of products are whole numbers that doubles hold
        self.ids, self.labels, self.kind = ids, labels, float if exact else object
        self.columns = np.ascontiguousarray(q.T).astype(self.kind)
        self.lo, self.hi = (self.columns.min(1), self.columns.max(1)) if len(ids) else (np.zeros(q.shape[1]), np.zeros(q.shape[1]))

    def scan(self, q: np.ndarray, alive: np.ndarray):
        """Yields places, lower and upper bounds of their scores after each few columns; takes the mask of places to go on with."""
        q = q.astype(self.kind)
        order = np.argsort(-np.abs(q), kind="stable")
        least, most = np.minimum(q * self.lo, q * self.hi)[order], np.maximum(q * self.lo, q * self.hi)[order]
        at, part = np.flatnonzero(alive), np.zeros(int(alive.sum()), self.kind)
        for k in range(0, max(1, len(order)), STEP):
            d = order[k : k + STEP]
            if len(at):
                part = part + q[d] @ (self.columns[d] if len(at) == len(self.ids) else self.columns[np.ix_(d, at)])
            keep = yield at, part + least[k + STEP :].sum(), part + most[k + STEP :].sum()
            at, part = at[keep], part[keep]


def _greatest(x: np.ndarray, k: int):
    """The k-th greatest."""
    return np.partition(x, len(x) - k)[len(x) - k] if x.dtype != object else sorted(x)[-k]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def positives_in(block: Columns, vec_id: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best other rows of the label."""
    scan = block.scan(q, (block.labels == label) & (block.ids != vec_id))
    at, low, high = next(scan)
    while True:
        keep = high >= _greatest(low, k) if len(at) > k else np.ones(len(at), bool)
        try:
            at, low, high = scan.send(keep)
        except StopIteration:
            at, low = at[keep], low[keep]
            break
    top = _best(block.ids[at], low, k)
    return block.ids[at[top]], low[top]


def negatives_in(block: Columns, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ends included, ids and scores of its k best rows of other labels."""
    scan = block.scan(q, block.labels != label)
    at, low, high = next(scan)
    while True:
        keep = np.zeros(len(at), bool)
        for a, b in windows:
            may = (high >= a) & (low <= b)
            sure = (low >= a) & (high <= b)
            if sure.sum() >= k:
                may &= high >= _greatest(low[sure], k)
            keep |= may
        try:
            at, low, high = scan.send(keep)
        except StopIteration:
            at, low = at[keep], low[keep]
            break
    out = []
    for a, b in windows:
        inside = np.flatnonzero((low >= a) & (low <= b))
        top = inside[_best(block.ids[at[inside]], low[inside], k)]
        out.append((block.ids[at[top]], low[top]))
    return out


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with 0."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Anchors and rows of each cell of a stream that is sorted by cell; a cell has two groups."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Table, pa.Table]:
        t = pa.Table.from_batches(held).combine_chunks()
        kind = t.column("anchor").to_numpy(zero_copy_only=False)
        return t.filter(pa.array(kind)), t.filter(pa.array(~kind))

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
        cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and [held[-1].column(c)[0].as_py() for c in (0, 1)] != cell[:, a].tolist():
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _dealt(rows: DataFrame, anchors: DataFrame, across: int, down: int) -> DataFrame:
    """Each row in the cells of its group with all groups of anchors, each anchor in those of its group with all groups of rows."""
    group = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    windows = "windows" if "windows" in anchors.columns else F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>").alias("windows")
    a = anchors.select(group(across).alias("x"), all_of(down).alias("y"), F.lit(True).alias("anchor"), "vec_id", "label", "q", windows)
    r = rows.select(all_of(across).alias("x"), group(down).alias("y"), F.lit(False).alias("anchor"), "vec_id", "label", "q", F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>").alias("windows"))
    return a.unionByName(r).repartition("x", "y").sortWithinPartitions("x", "y")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group: int = ROWS, anchor_group: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` come from ``quantised``; ``is_anchor`` is a condition on them. The window of a positive of score p holds
    the scores s of other labels with low * p <= 100 * s <= high * p.
    """
    rows = materialise(rows)
    anchors = rows.where(is_anchor)
    down, across = max(1, -(-rows.count() // group)), max(1, -(-anchors.count() // anchor_group))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, Columns]]:
        for a, r in _cells(batches):
            width = max([0, *(int(np.diff(t.column("q").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (a, r) if len(t))])
            if not len(a) or not len(r):
                continue
            qa, qr = (_matrix(t.column("q").combine_chunks(), width) for t in (a, r))
            bound = float(np.abs(qa).max(initial=0)) * float(np.abs(qr).max(initial=0)) * max(1, width)
            yield a, qa, Columns(r.column("vec_id").to_numpy(), r.column("label").to_numpy(), qr, bound)

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, qa, block in blocks(batches):
            out: list[tuple] = []
            for name, label, q in zip(a.column("vec_id").to_pylist(), a.column("label").to_pylist(), qa):
                ids, scores = positives_in(block, name, label, q, positives)
                out += [(name, int(i), int(s)) for i, s in zip(ids, scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["vec_id", "positive_id", "positive_score"])

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, qa, block in blocks(batches):
            out: list[tuple] = []
            for name, label, q, near in zip(a.column("vec_id").to_pylist(), a.column("label").to_pylist(), qa, a.column("windows").to_pylist()):
                windows = [(-(-low * w["positive_score"] // 100), high * w["positive_score"] // 100) for w in near]
                for w, (ids, scores) in zip(near, negatives_in(block, label, q, windows, negatives)):
                    out += [(name, w["positive_id"], w["positive_score"], int(i), int(s)) for i, s in zip(ids, scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([],) * 5)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = _dealt(rows, anchors, across, down).mapInArrow(tidy(find_positives), "vec_id bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id"))  # at most ``positives`` from each group
    near = found.withColumn("k", place).where(F.col("k") <= positives).groupBy("vec_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("windows"))
    opened = materialise(anchors.join(near, "vec_id"))
    met = _dealt(rows, opened, across, down).mapInArrow(tidy(find_negatives), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")).cast("int")
    out = materialise(met.withColumn("rank", place).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(rows, opened)
    return out


#: All scores of the anchors.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s FROM e a JOIN e b ON b.vec_id != a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.s BETWEEN 80 * p.s AND 100 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INT) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5
"""
