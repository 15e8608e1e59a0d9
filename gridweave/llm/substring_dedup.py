"""Removing long passages that repeat across documents, found through difference-cover anchors.

A difference cover modulo P has, for any two places, a shift below P that brings both onto the cover.
So if two documents share ``window`` words, some run of ``window - P + 1`` words inside starts on the
cover in both. Hashing only such anchors (six of 31 places) finds every shared window; an anchor that
two documents have is then extended: the windows that contain it are hashed whole, and the smallest
document of each window is looked up. All groups are aggregated to one row, never listed, so a passage
that a third of all documents share costs no more than any other; what it is looked up in is written
first, so that its rows are split over tasks where they are many.

Documents with equal words are joined into one first: all words of the later copies go, which is what
their windows would say. Hashes have 64 bits for anchors, where an error only costs time, and 128 for
windows.

Edge cases: null text has no words; texts of any length are read whole, one at a time; an empty table gives an
empty one; columns named like the added ones raise ValueError; fewer words than a window are never removed; a repeated doc_id is
no smaller than itself, so equal rows of one id stay; rows with a null doc_id are left as they are and
remove nothing; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import discard, materialise, tidy, unused_name

#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1024, 2 * n)
        run = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
        _POWERS[base] = run(np.uint64(base)), run(np.uint64(pow(base, -1, 1 << 64)))
    return _POWERS[base]


def run_hashes(hashes: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """64-bit hash of each run of ``size`` hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(base, len(hashes))
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    x = (total[size:] - total[:-size]) * down[:n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the cover and the hashes of the runs that start there."""
    found = run_hashes(hashes, size)
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(len(found)) % PERIOD])
    return at, found[at]


def _windows(hashes: np.ndarray, window: int, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and both hashes of each window; only those that contain an anchor in ``near`` if it is given."""
    a, b = run_hashes(hashes, window), run_hashes(hashes, window, _BASES[1])
    start = np.arange(len(a))
    if near is not None:
        size = window - PERIOD + 1
        at, found = anchors(hashes, size)
        marks = np.zeros(len(a) + 1, np.int64)
        at = at[np.isin(found, near)]
        np.add.at(marks, np.maximum(0, at + size - window), 1)
        np.add.at(marks, np.minimum(at, len(a) - 1) + 1, -1)
        start = start[np.cumsum(marks[:-1]) > 0]
    return start, a[start], b[start]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _read(column: pa.Array) -> list[np.ndarray]:
    return [np.empty(0, np.int64) if v is None else np.asarray(v, np.int64) for v in column.to_pylist()]


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add n_words, n_removed and kept_text (kept words joined by one space) to each row of ``docs``."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be above {PERIOD}")
    clash = {"n_words", "n_removed", "kept_text"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    size = window - PERIOD + 1
    digest, copy, hits = (unused_name(docs, x) for x in ("digest", "copy", "hits"))
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                names, digests, found = [], [], []
                for name, words in zip(part.column(0).to_pylist(), map(words_of, part.column(1).to_pylist())):
                    if name is None or len(words) < window:
                        continue
                    names.append(name)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    found.append(np.unique(anchors(word_hashes(words), size)[1].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "anchors"])

    signed = materialise(own.mapInArrow(tidy(sign), "doc_id bigint, digest binary, anchors array<bigint>"))
    first = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    chosen = signed.join(first.select("doc_id", "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    rows = chosen.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = materialise(shared)  # a table, not an aggregate: only then can the rows of a hot passage be split over tasks
    near = rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("near"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _read(batch.column(2))):
                _, a, b = _windows(word_hashes(words_of(body)), window, found.view(np.uint64))
                both = np.unique(np.stack([a, b], 1).view(np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), name)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "a", "b"])

    windows = own.join(near, "doc_id").mapInArrow(tidy(extend), "doc_id bigint, a bigint, b bigint")
    windows = materialise(windows)
    discard(shared)
    low = windows.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "b", "low")
    low = materialise(low)
    late = windows.join(low, ["a", "b"]).where("low < doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    late = late.select("doc_id", F.col("pairs.a").alias("a"), F.col("pairs.b").alias("b"))
    late = materialise(late)
    discard(windows, low)
    copies = signed.select("doc_id", "digest").join(first.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").distinct()
    copies = copies.groupBy("doc_id").agg(F.collect_set("digest").alias(copy))
    marks = late.join(copies, "doc_id", "full").withColumn(hits, F.struct(F.coalesce("a", F.array().cast("array<bigint>")).alias("a"), F.coalesce("b", F.array().cast("array<bigint>")).alias("b"), F.coalesce(copy, F.array().cast("array<binary>")).alias("copies")))
    marks = materialise(marks)
    discard(signed, late)
    marked = docs.join(marks.select(F.col("doc_id").alias(digest), hits), F.col(doc_id).cast("bigint") == F.col(digest), "left").drop(digest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            for body, hit in zip(batch.column(text).to_pylist(), batch.column(hits).to_pylist()):
                words = words_of(body)
                removed = np.zeros(len(words), bool)
                if hit and len(words) >= window:
                    if hit["copies"] and xxhash.xxh3_128_digest(b" ".join(words)) in hit["copies"]:
                        removed[:] = True
                    elif hit["a"]:
                        start, a, b = _windows(word_hashes(words), window)
                        want = set(zip(hit["a"], hit["b"]))
                        maybe = np.flatnonzero(np.isin(a.view(np.int64), hit["a"]))
                        marks_ = np.zeros(len(words) + 1, np.int64)
                        for s, x, y in zip(start[maybe].tolist(), a[maybe].view(np.int64).tolist(), b[maybe].view(np.int64).tolist()):
                            if (x, y) in want:
                                marks_[s] += 1
                                marks_[s + window] -= 1
                        removed = np.cumsum(marks_[:-1]) > 0
                counts.append(len(words))
                gone.append(int(removed.sum()))
                kept.append(b" ".join([w for w, r in zip(words, removed.tolist()) if not r] if gone[-1] else words).decode())
            rest = [c for c in batch.schema.names if c != hits]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*rest, "n_words", "n_removed", "kept_text"])

    return marked.mapInArrow(tidy(keep), f"{fields}, n_words bigint, n_removed bigint, kept_text string")
