"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and the beginnings of words (``STEMS`` letters), lower-cased. Every term counts, in examples and in
queries; a query's terms that no example has count in its length. A term weighs (1 + log tf) * idf, where idf is
counted over all documents, times 1 + sqrt(chi-square) of its presence with the label among the examples, so that what
tells the classes apart isn't drowned by the rest; no term is left out for being rare or even. That factor is a departure
from plain TF-IDF: without it 64 of 97 held-out toxic texts of a labelled test table are found, with it 92.

A term is a 64-bit hash of its text from the start; no string leaves the task that read it. The sample comes to the driver
in ``SLICES`` parts, as ids and counts.

Examples are held in blocks of ``BLOCK``. The ``DENSE`` most common terms are kept as matrices by block, with the greatest
weight of each term in each block, all others as postings. A query adds up its postings exactly; that and
the common terms' greatest weights bound every block. The blocks of the highest bounds are scored first, then all
whose bound reaches the k-th best of these: the neighbours are the exact ones.

The neighbours vote with weight 1 / (distance + ``SOFT``). A logistic curve makes that a calibrated score: it is fitted to
the votes that examples get from an index of the other ``FOLDS`` - 1 parts of them, whose weights know nothing of their labels. A text without any term gets the rate among examples
without any. Evidence is the ids and cosines of the nearest neighbours.

Training takes at most ``max_examples`` labelled rows, chosen by hash; everything else sees every row.

Edge cases: null text counts as empty; texts of any length are read whole; repeated rows each get their score, and each
counts as a document; where ids of examples repeat, equal texts teach once, and at most ``MOST_ROWS`` times ``max_examples`` different ones, chosen by
hash, so that the sample stays bounded; without labels, or with one class only, the score is the rate, or 0 with
no labels at all; an empty table of documents gives no rows, columns of it with an added name raise ValueError; conflicting labels of one id all count; ties in cosine (to six digits) go to the smaller id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import discard, give_back, held_out, materialise, tidy

STEMS, BLOCK, NEIGHBOURS, SOFT, DENSE = (4, 5, 6), 64, 15, 0.05, 1024
_WORD = re.compile(r"\w+")
#: A blank for each ASCII byte that isn't in words.
_SIGNS = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
#: Blocks that are scored first, besides those that k neighbours fill.
FIRST = 8
#: For each place in a term and byte there.
_RANDOM = np.random.default_rng(20250711).integers(0, 1 << 64, (64, 256), dtype=np.uint64)
#: Parts of the examples in calibration, examples tried in it, and parts in which the sample comes to the driver.
FOLDS, TRIED, SLICES = 4, 2000, 16
#: Different texts that teach, at most, for each labelled id.
MOST_ROWS = 4
#: Texts, and bytes of text, whose terms are counted at once, and texts whose scores are held at once.
_GROUP, _STEP, _AT_ONCE = 256, 3 << 18, 64
#: Terms of examples that are put in an index at a time.
_TERMS = 1 << 18


def terms_of(text: str) -> tuple[str, ...]:
    """Terms of a text, as often as they stand; ``tally`` counts the same for many texts at once."""
    out = []
    for w in _WORD.findall(text.lower()):
        out.append(w)
        out += [f"{w[:n]}-" for n in STEMS if len(w) > n]
    return tuple(out)


@dataclass
class Counts:
    """Terms of consecutive texts: by text and term, rising; ``term`` is a place in ``ids``."""

    size: int
    ids: np.ndarray
    text: np.ndarray
    term: np.ndarray
    times: np.ndarray


def ids_of(names: pa.Array | np.ndarray) -> np.ndarray:
    """64-bit hashes of the texts of terms: sums of a random number for each byte at each place, of long ones another hash."""
    names = pa.array(names, pa.large_string())
    data = names.buffers()[2]
    if data is None or not len(names):
        return np.zeros(len(names), np.int64)
    at = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1, 8 * names.offset)
    size = np.diff(at)
    out, some = np.zeros(len(names), np.uint64), np.flatnonzero((size > 0) & (size <= len(_RANDOM)))
    n, first = size[some], np.cumsum(size[some]) - size[some]
    if len(some):
        place = np.arange(n.sum()) - np.repeat(first, n)
        held = np.frombuffer(data, np.uint8)[place + np.repeat(at[some], n)]
        out[some] = np.add.reduceat(_RANDOM.ravel()[(place << 8) + held], first)
    for k in np.flatnonzero(size > len(_RANDOM)).tolist():
        out[k] = xxhash.xxh3_64_intdigest(names[k].as_py())
    return out.view(np.int64)


def places_in(known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each id among rising ones, or -1."""
    if not len(known):
        return np.full(len(ids), -1, np.int64)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, at, -1)


def _spaced(texts: pa.Array) -> pa.Array:
    """Blanks for all that isn't in words. What isn't ASCII is looked for by itself, as few texts have such signs."""
    data = texts.buffers()[2]
    if data is None:
        return texts
    plain = pa.Array.from_buffers(texts.type, len(texts), [None, texts.buffers()[1], pa.py_buffer(data.to_pybytes().translate(_SIGNS))], offset=texts.offset)
    odd = pc.match_substring_regex(plain, r"[^\pL\pN_ ]")
    return pc.replace_with_mask(plain, odd, pc.replace_substring_regex(plain.filter(odd), r"[^\pL\pN_]+", " ")) if pc.any(odd).as_py() else plain


def _levels(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of words, and of their beginnings of each number of letters: ids of the terms; text, term and times of each pair of these, rising."""
    words = pc.ascii_split_whitespace(_spaced(pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))))
    flat = words.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    text = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    own, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    letters = pc.utf8_length(own).to_numpy(zero_copy_only=False)
    dash, none = pa.scalar("-", pa.large_string()), pa.scalar("", pa.large_string())
    for n in (0, *STEMS):
        names, at, row = own, word, text
        if n:
            long = letters > n
            coded = pc.binary_join_element_wise(pc.utf8_slice_codeunits(own.filter(pa.array(long)), 0, n), dash, none).dictionary_encode()
            of_word = np.full(len(own), -1)
            of_word[long] = coded.indices.to_numpy(zero_copy_only=False)
            at = of_word[word]
            names, at, row = coded.dictionary, at[at >= 0], text[at >= 0]
        pair = np.sort(row * max(1, len(names)) + at)
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        yield ids_of(names), *np.divmod(pair[new], max(1, len(names))), np.diff(new, append=len(pair))


def tally(texts: pa.Array) -> Counts:
    """How often each term stands in each text."""
    names, text, term, times = zip(*_levels(texts))
    text, term = np.concatenate(text), np.concatenate([t + n for t, n in zip(term, np.cumsum([0, *map(len, names)]))])
    order = np.argsort(text.astype(np.uint16) if len(texts) < 1 << 16 else text, kind="stable")
    return Counts(len(texts), np.concatenate(names), text[order], term[order], np.concatenate(times)[order])


def _groups(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of at most ``_GROUP`` texts and ``_STEP`` bytes, or one text, and the place of the first."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(lo + _GROUP, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _STEP, "right"))))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


@dataclass
class Index:
    """The examples' weights in blocks, and what turns votes into scores."""

    known: np.ndarray  # ids of terms, rising
    codes: np.ndarray  # their places by falling number of examples
    idf: np.ndarray  # by place
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # blocks, common terms, places
    tops: np.ndarray  # blocks, common terms
    without: float
    unseen: float = 1.0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings of the other terms
    postings: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int32))  # place, and bits of the weight there
    slope: float = 1.0
    shift: float = 0.0

    @property
    def places(self) -> np.ndarray:
        return self.postings[:, 0]

    @property
    def values(self) -> np.ndarray:
        return self.postings.view(np.float32)[:, 1]

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest of a text with terms ``at`` and weights ``w``, exactly; ``but`` is left out."""
        return self.nearest_of(1, np.zeros(len(at), np.int64), at, w, k, [but])[0]

    def _postings(self, size: int, text: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums over the terms that aren't held as matrices: a row for each text, a column for each place."""
        width = self.weights.shape[0] * self.weights.shape[2]
        scores = np.zeros((size, width), self.weights.dtype)
        first, last = self.starts[at], self.starts[at + 1]
        cuts, n = np.searchsorted(text, np.arange(size + 1)).tolist(), last - first
        held, per = memoryview(self.postings).cast("B") if len(self.postings) else b"", self.postings.itemsize * 2
        runs = [*map(slice, (first * per).tolist(), (last * per).tolist())]  # a term's postings lie together and are copied as one
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):  # one text's rows stay in the processor's cache
            if lo < hi:
                own = np.frombuffer(b"".join([*map(held.__getitem__, runs[lo:hi])]), np.int32)
                gain = np.repeat(w[lo:hi], n[lo:hi])
                gain *= own.view(np.float32)[1::2]
                scores[k] = np.bincount(own[::2], gain, width)
        return scores

    def nearest_of(self, size: int, text: np.ndarray, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for ``size`` texts; all three arrays have a place for each term of a text, by text."""
        blocks, common, width = self.weights.shape
        q = np.zeros((size, common), self.weights.dtype)
        often = at < common
        q[text[often], at[often]] = w[often]
        scores = self._postings(size, text[~often], at[~often] - common, w[~often]).reshape(size, blocks, width)
        bounds = q @ self.tops.T + scores.max(2)
        done = np.zeros(bounds.shape, bool)

        def complete(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                own = np.flatnonzero(wanted[:, b])
                scores[own, b] += q[own] @ self.weights[b]
            done[wanted] = True

        best = np.argsort(-bounds, 1, "stable")[:, : FIRST + -(-k // width)]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, best, True, 1)
        complete(first & (bounds > 0))
        if but is not None:
            for i, place in enumerate(but):
                if place >= 0:
                    scores[i, place // width, place % width] = -np.inf
        seen = np.where(np.take_along_axis(done, best, 1)[:, :, None], np.take_along_axis(scores, best[:, :, None], 1), 0).reshape(size, -1)
        reached = np.partition(seen, -k, 1)[:, -k] if k < seen.shape[1] else np.zeros(size)
        complete(~done & (bounds > 0) & (bounds >= np.maximum(reached, 0)[:, None] - 1e-5))
        out = []
        seen = np.where(done[:, :, None], scores, 0).reshape(size, -1)
        reached = np.partition(seen, -k, 1)[:, -k] if k < seen.shape[1] else np.zeros(size)
        for row, least in zip(seen, reached):
            found = np.flatnonzero((row > 0) & (row >= least - 1e-6))
            cosines = row[found].astype(float)
            order = np.lexsort((self.ids[found], -np.round(cosines, 6)))[:k]
            out.append((found[order], cosines[order]))
        return out

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        power = 1 / (1 - np.minimum(cosines, 1) + SOFT)
        return float((power @ self.labels[places] + 0.5 * self.without) / (power.sum() + 0.5)) if len(places) else self.without

    def score(self, counts: Counts) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, places and cosines for each text. A term that no example has counts in the length."""
        out = [(self.without, np.empty(0, np.int64), np.empty(0))] * counts.size
        if not len(self.ids):
            return out
        known = places_in(self.known, counts.ids)
        known = np.where(known >= 0, self.codes[known], -1)
        idf = np.where(known >= 0, self.idf[known], self.unseen)
        w = (1 + np.log(counts.times)) * idf[counts.term]
        w /= np.sqrt(np.bincount(counts.text, w * w, counts.size))[counts.text]
        at = known[counts.term]
        some = at >= 0
        text, at, w = counts.text[some], at[some], w[some]
        for lo in range(0, counts.size, _AT_ONCE):
            own = slice(*np.searchsorted(text, [lo, lo + _AT_ONCE]))
            part = min(_AT_ONCE, counts.size - lo)
            for i, (places, cosines) in enumerate(self.nearest_of(part, text[own] - lo, at[own], w[own]), lo):
                if len(places):
                    v = min(max(self.vote(places, cosines), 1e-4), 1 - 1e-4)
                    x = self.slope * math.log(v / (1 - v)) + self.shift
                    out[i] = 1 / (1 + math.exp(-min(max(x, -30.0), 30.0))), places, cosines
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a mild pull to the identity."""
    theta, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        g = design.T @ (p - y) + 1.0 * (theta - [1, 0])
        h = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
        theta = theta - np.linalg.solve(h, g)
    return max(float(theta[0]), 0.05), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, max_examples: int = 8000) -> Index:
    """Learn from rows of ``docs`` with a label whose id isn't held out; at most ``max_examples`` of them."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id", "toxic"), "id").limit(max_examples)
    # at most max_examples rows of 12 bytes
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "toxic", F.xxhash64("text").alias("h"), "text")
    # ids may repeat: a bounded number of different texts, equal ones once; again short rows
    picked = labelled.select("id", "toxic", "h").distinct().orderBy(F.xxhash64("id", "toxic", "h"), "id", "toxic", "h").limit(MOST_ROWS * max_examples)
    sample = labelled.join(F.broadcast(picked), ["id", "toxic", "h"]).groupBy("id", "toxic", "h").agg(F.first("text").alias("text")).select("id", "toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _groups(batch.column(2)):
                c = tally(texts)
                ends = np.searchsorted(c.text, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), batch.column(1).slice(lo, len(texts)), pa.ListArray.from_arrays(ends, pa.array(c.ids[c.term])), pa.ListArray.from_arrays(ends, pa.array(c.times.astype(np.int32)))], names=["id", "toxic", "at", "n"])

    counted = materialise(sample.mapInArrow(tidy(count), "id bigint, toxic int, at array<bigint>, n array<int>").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int")))
    parts = []
    for k in range(SLICES):  # what Spark holds for the driver is one of these at a time
        rows = counted.where(F.col("slice") == k).toArrow()
        lists = [rows[c].combine_chunks() for c in ("at", "n")]
        size = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        parts.append((rows["id"].to_numpy(), rows["toxic"].to_numpy().astype(np.int8), size, pc.list_flatten(lists[0]).to_numpy(zero_copy_only=False), np.log(pc.list_flatten(lists[1]).to_numpy(zero_copy_only=False)).astype(np.float32)))
        del rows, lists
    discard(counted)
    ids, toxic, per, gain = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 4))
    terms = [p[3] for p in parts]
    del parts
    gain += 1
    size, positive = len(ids), int(toxic.sum())
    rate = positive / size if size else 0.0
    if not 0 < positive < size:
        none = np.empty(0, np.int64)
        return Index(none, none, np.empty(0), none, np.empty(0), np.empty((0, 0, BLOCK)), np.empty((0, 0)), float(rate))
    known = np.unique(np.concatenate([*map(np.unique, terms)]))
    for k, term in enumerate(terms):  # one after another, so that places come where ids go
        terms[k] = np.searchsorted(known, term).astype(np.int32)
    del term
    at = np.concatenate(terms)
    del terms
    give_back()  # the driver's memory is small, and the next step runs on all documents
    every, common_to = _document_counts(docs, known)
    base = np.log((1 + every) / (1 + common_to)) + 1
    start = np.cumsum(per) - per
    by_id = np.lexsort((start, toxic, ids))
    rows = Examples(ids, toxic.astype(float), start, per, at, gain)
    fold = np.empty(size, np.int64)
    fold[by_id] = np.random.default_rng(5).permutation(size) % FOLDS
    votes, truth = [], []
    for f in range(FOLDS):
        own = by_id[fold[by_id] == f]
        own = own[per[own] > 0][: TRIED // FOLDS]
        part = build(rows, by_id[fold[by_id] != f], known, base, every)
        for k in range(0, len(own), _AT_ONCE):
            some = own[k : k + _AT_ONCE]
            n = per[some]
            held = np.repeat(start[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            code = part.codes[at[held]]
            w = gain[held] * np.where(code >= 0, part.idf[code], part.unseen)
            text = np.repeat(np.arange(len(some)), n)
            w = w / np.sqrt(np.bincount(text, w * w, len(some)))[text]
            in_it = code >= 0
            for r, (places, cosines) in zip(some, part.nearest_of(len(some), text[in_it], code[in_it], w[in_it])):
                if len(places):
                    votes.append(part.vote(places, cosines))
                    truth.append(toxic[r])
        del part
    give_back()
    index = build(rows, by_id, known, base, every)
    if votes:
        votes = np.clip(votes, 1e-4, 1 - 1e-4)
        index.slope, index.shift = _logistic(np.log(votes / (1 - votes)), np.array(truth, float))
    del rows, at, gain
    give_back()
    return index


@dataclass
class Examples:
    """Labelled texts and their terms: ``per`` of them from ``start`` on, by number in the rising ids of all terms, with 1 + log tf."""

    ids: np.ndarray
    toxic: np.ndarray
    start: np.ndarray
    per: np.ndarray
    at: np.ndarray
    gain: np.ndarray


def build(rows: Examples, chosen: np.ndarray, known: np.ndarray, base: np.ndarray, every: int) -> Index:
    """The index of some of the examples; labels of others have no part in it. ``base`` is the idf of the terms in ``known``."""
    size, toxic, per, ids = len(chosen), rows.toxic[chosen], rows.per[chosen], rows.ids[chosen]
    positive, ends = toxic.sum(), np.cumsum(per)
    at, w = np.empty(per.sum(), np.int32), np.empty(per.sum(), np.float32)
    have, bad = np.zeros(len(known)), np.zeros(len(known))
    for own, row in _pieces(per):
        held = np.arange(own.start, own.stop) + (rows.start[chosen] - ends + per)[row]
        at[own], w[own] = rows.at[held], rows.gain[held]
        have += np.bincount(at[own], minlength=len(known))
        bad += np.bincount(at[own], toxic[row], len(known))
    order = np.lexsort((known, -have))[: int((have > 0).sum())]
    codes = np.full(len(known), -1, np.int32)
    codes[order] = np.arange(len(order))
    have, bad = have[order], bad[order]
    chi2 = size * (bad * (size - positive) - (have - bad) * positive) ** 2 / np.maximum(have * (size - have) * positive * (size - positive), 1)
    idf = base[order] * (1 + np.sqrt(np.where(have < size, chi2, 0)))
    for own, row in _pieces(per):
        at[own] = codes[at[own]]
        w[own] *= idf[at[own]].astype(np.float32)
        w[own] /= np.sqrt(np.bincount(row - row[0], w[own].astype(float) ** 2)).astype(np.float32)[row - row[0]]
    # examples whose heaviest terms are the same share blocks
    some = np.flatnonzero(per)
    heavy = {int(r): tuple(at[lo:hi][np.lexsort((at[lo:hi], -w[lo:hi]))[:3]].tolist()) for r, lo, hi in zip(some, (ends - per)[some], ends[some])}
    some = np.array(sorted(heavy, key=lambda r: (heavy[r], r)), np.int64)
    del heavy
    place = np.full(size, -1, np.int32)
    place[some] = np.arange(len(some))
    common, blocks = min(DENSE, len(order)), max(1, -(-len(some) // BLOCK))
    weights = np.zeros((blocks, common, BLOCK), np.float32)
    starts = np.concatenate([[0], np.cumsum(have[common:])]).astype(np.int64)
    postings, free = np.empty((starts[-1], 2), np.int32), starts[:-1].copy()
    places, values = postings[:, 0], postings.view(np.float32)[:, 1]
    for own, row in _pieces(per):
        term, gain, where = at[own], w[own], place[row]
        often = term < common
        weights[where[often] // BLOCK, term[often], where[often] % BLOCK] = gain[often]
        rest = np.flatnonzero(~often)
        rest = rest[np.argsort(term[rest], kind="stable")]
        code, first, n = np.unique(term[rest] - common, return_index=True, return_counts=True)
        to = np.arange(len(rest)) + np.repeat(free[code] - first, n)
        places[to], values[to] = where[rest], gain[rest]
        free[code] += n
    bare, rate = per == 0, positive / size
    return Index(known, codes, idf, ids[some], toxic[some], weights, weights.max(2), float((toxic[bare].sum() + rate) / (bare.sum() + 1)), math.log(1 + every) + 1, starts, postings)


def _pieces(per: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Terms of consecutive examples, about ``_TERMS`` at a time so that what is worked out for them stays small, and the example of each."""
    ends, lo = np.cumsum(per), 0
    while lo < len(per):
        begin = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + _TERMS, "right")))
        if ends[hi - 1] > begin:
            yield slice(begin, int(ends[hi - 1])), np.repeat(np.arange(lo, hi), per[lo:hi])
        lo = hi


def _document_counts(docs: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and in how many of them each of the terms stands. As many rows as terms reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # ids of the sample's terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        found, size = np.zeros(len(own) + 1, np.int64), 0
        for batch in batches:
            for _, texts in _groups(batch.column(0)):
                for names, _, term, _ in _levels(texts):
                    place, n = places_in(own, names), np.bincount(term, minlength=len(names))
                    np.add.at(found, place[place >= 0], n[place >= 0])
                size += len(texts)
        found[-1] = size
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(tidy(count), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(known) + 1)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return int(out[-1]), out[:-1]


def score(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Add score, predicted, neighbours (ids) and cosines to each row of ``docs``. No shuffle."""
    added = ["score", "predicted", "neighbours", "cosines"]
    clash = set(added) & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    # bounded by max_examples and how many terms a text has: 8 bytes for each pair of these, and no strings
    shared = docs.sparkSession.sparkContext.broadcast(index)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, texts in _groups(batch.column(text)):
                found = own.score(tally(texts))
                values = [f[0] for f in found]
                columns = [pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32()), pa.array([own.ids[f[1]].tolist() if len(f[1]) else [] for f in found], pa.list_(pa.int64())), pa.array([f[2].tolist() for f in found], pa.list_(pa.float64()))]
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added])
            found = columns = part = texts = batch = None
            give_back()  # what the texts of one batch took isn't kept beside the next

    return docs.mapInArrow(tidy(run), f"{fields}, score double, predicted int, neighbours array<bigint>, cosines array<double>")
