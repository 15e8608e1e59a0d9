"""Near-duplicate documents by order MinHash over shingles of five words.

Each shingle is labelled with its occurrence, so that a repeated one counts as often as it stands. A
sketch takes the ``TAKEN`` smallest labelled shingles under one hash function and keeps them in the
order of the text, so two texts agree in a sketch as often as they share shingles in the same order.
``ROWS`` sketches form a key; two texts with a key in common are a candidate pair: of pairs at a similarity of 0.8
all but 0.0002.

Candidates are verified by banded alignment: the longest common subsequence of both texts' labelled
shingles, within the band that a similarity of ``threshold`` leaves, over the size of their union. With
labels no shingle stands twice, so the alignment is the longest increasing run of matched places.

Equal texts are one node from the start. Texts with a key form a group. First all of a group are compared with its
most central texts, those with the largest groups over all their keys: one of them, or ``LEADERS`` of a group above ``SMALL``
texts. So a text and its near copies become one class by a few comparisons each, and groups whose texts are in one class
are done. Of the others, those of at most ``SMALL`` texts are compared in pairs, but for pairs of one class. A larger
group is split by each second key that is in a large group too; the parts are compared in pairs again or, above ``SMALL``,
with their ``LEADERS`` most central texts. What these rounds leave of the large groups, all pairs of different classes in
groups that aren't one class yet, is then compared whole: the group is dealt to cells of two shares of at most about ``SHARE`` texts.

Before texts are aligned, bitmaps must allow it: a text's bitmap holds the parities of how many of its shingles fall in
each place, so two bitmaps differ in no more places than the texts have shingles of their own, and no pair that reaches the
threshold is turned away.

So no group is cut, no text left out, and each pair with a key in common is joined by others, ruled out by its bitmaps or
sizes, or aligned. A link can be missed only where two texts share no key (0.0002 at a similarity of 0.8). The work is linear in the number of
keys, but for texts of large groups that are no near copies of each other: their bitmaps are compared in pairs.

Edge cases: fewer than five words form one shingle; texts without words and rows without doc_id are
classes of their own (class_id is doc_id) and are kept; repeated rows of one id share their class, different texts of
one id as well; an empty table gives an empty one; columns that already have an added name raise ValueError.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import discard, materialise, tidy, unused_name
from gridweave.llm.substring_dedup import run_hashes, word_hashes, words_of
from gridweave.operators.graph import connected

SHINGLE, TAKEN, ROWS, KEYS = 5, 2, 2, 16
SMALL, LEADERS, SHARE = 32, 4, 1024
#: Least and most places of a bitmap.
NARROW, WIDE = 64, 1 << 15
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, KEYS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Shingles expected under the bound below which a sketch looks for its smallest ones.
_TRIED = 10
#: Words that are signed at a time.
_STEP = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _label(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence within their text mixed in."""
    own = grams ^ (text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(own)
    ranked = own[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    nth = np.zeros(len(grams), np.uint64)
    if same.any():
        held = np.flatnonzero(same | np.append(same[1:], False))
        by_place = np.lexsort((order[held], ranked[held]))
        run = ranked[held][by_place]
        nth[order[held][by_place]] = (np.arange(len(run)) - np.searchsorted(run, run)).astype(np.uint64)
    return _mix(grams + nth * np.uint64(0xA0761D6478BD642F))


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of texts whose words' hashes lie one after another, and how many each text has."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    grams = run_hashes(hashes, SHINGLE)
    whole = np.arange(len(hashes)) + SHINGLE <= np.repeat(ends, lengths)
    whole[starts[(lengths > 0) & (lengths < SHINGLE)]] = True
    out = np.zeros(len(hashes), np.uint64)
    out[: len(grams)] = grams
    for k in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        out[starts[k]] = run_hashes(hashes[starts[k] : ends[k]], int(lengths[k]))[0]
    text = np.repeat(np.arange(len(lengths)), lengths)[whole]
    return _label(out[whole], text), np.bincount(text, minlength=len(lengths))


def labelled(words: list[bytes]) -> np.ndarray:
    """Hashes of one text's shingles in text order, each with its occurrence."""
    return shingles(word_hashes(words), np.array([len(words)]))[0]


def sketches(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches of texts (none of them empty) whose labelled shingles lie one after another: a row of 32-bit values each."""
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    most = np.iinfo(np.uint64).max
    bound = np.full(len(sizes), most)
    long = sizes > _TRIED
    bound[long] = (_TRIED / sizes[long] * 2.0**64).astype(np.uint64)
    bound = np.repeat(bound, sizes)
    out = np.empty((len(sizes), len(_SEEDS)), np.uint32)
    for k, a in enumerate(_SEEDS):
        at = np.flatnonzero(grams * a <= bound)
        few = np.flatnonzero(np.bincount(text[at], minlength=len(sizes)) < np.minimum(sizes, TAKEN))
        if len(few):  # too few below the bound: take all of that text
            at = np.union1d(at, np.concatenate([np.arange(ends[t] - sizes[t], ends[t]) for t in few]))
        rank, owner = grams[at] * a, text[at]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        per = np.diff(first, append=len(owner))
        places = np.empty((TAKEN, len(sizes)), np.int64)
        for n in range(TAKEN):
            places[n] = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, first), per))
            rank[places[n][per > n + 1]] = most
        value = np.full(len(sizes), k, np.uint64)
        for p in np.sort(places, 0):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + grams[at[p]])
        out[:, k] = value >> np.uint64(32)
    return out


def keys_of(drawn: np.ndarray) -> np.ndarray:
    """The keys of each row of sketches."""
    out = np.tile(np.arange(KEYS, dtype=np.uint64), (len(drawn), 1))
    for column in drawn.reshape(len(drawn), KEYS, ROWS).astype(np.uint64).transpose(2, 0, 1):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def sketch_keys(grams: np.ndarray) -> np.ndarray:
    """The keys of one text."""
    return keys_of(sketches(grams, np.array([len(grams)])))[0]


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity by banded alignment; 0 where the sizes or the matches rule ``threshold`` out."""
    n, m = len(a), len(b)
    least = threshold / (1 + threshold) * (n + m)  # matches that the threshold asks for
    if not n or not m or min(n, m) < least - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= n + m - 2 * least + 1e-9
    j = j[near][np.argsort(i[near])]
    if len(j) < least - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        run = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        run = len(tails)
    return run / (n + m - run)


def bitmaps(grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each text (none empty) the parities of its shingles by place; there are as many places as the next power of two above its shingles."""
    wide = np.clip(1 << np.ceil(np.log2(sizes)).astype(np.int64), NARROW, WIDE)
    ends = np.cumsum(wide)
    at = np.repeat(ends - wide, sizes) + (grams & np.repeat(wide - 1, sizes).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(ends[-1])) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip((ends - wide).tolist(), ends.tolist())]


def allowed(size: np.ndarray, bits: list[bytes], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For texts of rising sizes: each text's place and the places after it whose texts may reach the threshold with it."""
    wide = np.array([*map(len, bits)])
    first, held = len(bits), np.empty((0, 0), np.uint8)
    for width in np.unique(wide)[::-1].tolist():
        while held.size and held.shape[1] > width:  # a bitmap folded is that of half as many places
            held = held[:, : held.shape[1] // 2] ^ held[:, held.shape[1] // 2 :]
        low = int(np.searchsorted(wide, width))
        own = np.frombuffer(b"".join(bits[low:first]), np.uint8).reshape(-1, width)
        held = np.concatenate([own, held]) if held.size else own
        words = np.ascontiguousarray(held).view(np.uint64)
        most = np.searchsorted(size, size[low:first] / threshold + 1e-6, "right")
        for k, hi in zip(range(low, first), most.tolist()):
            if hi > k + 1:
                apart = np.bitwise_count(words[k + 1 - low : hi - low] ^ words[k - low]).sum(1, dtype=np.int64)
                yield k, k + 1 + np.flatnonzero(apart <= (size[k] + size[k + 1 : hi]) * (1 - threshold) / (1 + threshold) + 1e-6)
        first = low


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(0)))
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 6 * _STEP, "right")))
            part = texts.slice(lo, hi - lo)
            lists = pc.ascii_split_whitespace(part)
            words, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
            lengths = np.diff(np.concatenate([[0], np.cumsum(real)])[at])
            coded = words.filter(pa.array(real)).dictionary_encode()
            hashes = word_hashes([w.encode() for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()])[coded.indices.to_numpy()]
            some = np.flatnonzero(lengths)
            grams, sizes = shingles(hashes, lengths[some])
            cuts = np.concatenate([[0], np.cumsum(lengths[some])])
            digests = [xxhash.xxh3_128_digest(hashes[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            drawn = sketches(grams, sizes) if len(some) else np.empty((0, len(_SEEDS)), np.uint32)
            packed = [squeeze(t.encode()) for t in part.take(pa.array(some)).to_pylist()]
            keys = keys_of(drawn).view(np.int64)
            keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, KEYS, dtype=np.int32), pa.array(keys.ravel()))
            bits = bitmaps(grams, sizes) if len(some) else []
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int32)), keys, pa.array(bits, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "digest", "size", "keys", "bits", "packed"])
            lo = hi


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, len(whole), 256)):
            good = []
            for left, right in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist()):
                if left != last[0]:
                    last = left, labelled(words_of(expand(left).decode()))
                good.append(aligned(last[1], labelled(words_of(expand(right).decode())), threshold) >= threshold - 1e-12)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    # first the end that stands in few pairs; the other may be the centre of a large group, which a plain join lets adaptive execution split
    return pairs.join(right, "b").join(left, "a").select("a", "b", "pa", "pb").mapInArrow(tidy(run), "a bigint, b bigint")


def _possible(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose bitmaps allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "ba", "bb"))):
                n, m, x, y = (n, m, x, y) if n <= m else (m, n, y, x)
                good.append(any(len(k) for _, k in allowed(np.array([n, m]), [x, y], threshold)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "ba", "bb").mapInArrow(tidy(run), "a bigint, b bigint")


def _rest(entries: DataFrame, texts: DataFrame, threshold: float, share: int = SHARE) -> DataFrame:
    """All pairs ``a, b`` of different classes within each group whose bitmaps allow the threshold. A large group is dealt to cells, one for each two of its shares."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("size", "ascending"), ("node", "ascending")])
        node, size, part, own = (cell[c].to_numpy() for c in ("node", "size", "part", "own"))
        crossed = cell["i"][0].as_py() != cell["j"][0].as_py()  # two different shares: pairs within one are in its own cell
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, found in allowed(size.astype(np.int64), cell["bits"].to_pylist(), threshold):
            found = found[(part[found] != part[k]) & ((own[found] != own[k]) | (not crossed))]
            a.append(np.full(len(found), node[k]))
            b.append(node[found])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    shares = F.ceil(F.col("n") / share).cast("int")
    of = [c for c in ("node", "size") if c in texts.columns]  # texts of different sizes may have one id
    held = texts.select(*of, "bits")
    own = entries.join(held, of).withColumn("shares", shares).withColumn("own", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "part", "bits")
    return dealt.groupBy("band", "key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of different classes within each group."""
    other = entries.select("band", "key", F.col("node").alias("n2"), F.col("size").alias("s2"), F.col("part").alias("p2"))
    found = entries.join(other, ["band", "key"]).where((F.col("node") < F.col("n2")) & (F.col("part") != F.col("p2")) & _fits("size", "s2", threshold))
    return found.select(F.col("node").alias("a"), F.col("n2").alias("b"))


def _led(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a leader ``a`` and a text ``b`` of another class in its group: the most central text of each of ``LEADERS`` shares, or of a small group."""
    share = F.when(F.col("n") > SMALL, F.pmod(F.xxhash64("node"), F.lit(LEADERS))).otherwise(0)
    heads = entries.groupBy("band", "key", share.alias("share")).agg(F.max(F.struct("sum", "node", "size", "part")).alias("x"))
    heads = materialise(heads.select("band", "key", F.col("x.node").alias("head"), F.col("x.size").alias("s2"), F.col("x.part").alias("p2")))
    found = entries.join(heads, ["band", "key"]).where((F.col("part") != F.col("p2")) & _fits("size", "s2", threshold))
    return found.select(F.col("head").alias("a"), F.col("node").alias("b"))


def _fits(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9


def _renamed(df: DataFrame, roots: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with the column ``new``: the root of the node in ``old``, or that node."""
    to = roots.select(F.col("node").alias("node_"), F.col("root").alias("root_"))
    return df.join(to, F.col(old) == F.col("node_"), "left").withColumn(new, F.coalesce("root_", old)).drop("node_", "root_")


def _open(entries: DataFrame) -> DataFrame:
    """Entries in groups that more than one class shares, with the group's number of entries."""
    # written, so that the join of a group with its entries stands alone and adaptive execution may split it
    groups = materialise(entries.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band", "key", "n"))
    return entries.join(groups, ["band", "key"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add class_id (the least doc_id of the class) and kept to each row of ``docs``."""
    clash = {"class_id", "kept"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    signed = materialise(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_sign), "doc_id bigint, digest binary, size int, keys array<bigint>, bits binary, packed binary"))
    firsts = materialise(signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    chosen = signed.join(firsts.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"])
    nodes = materialise(chosen.groupBy(F.col("doc_id").alias("node"), "digest").agg(F.first("size").alias("size"), F.first("keys").alias("keys")))
    entries = nodes.select("node", "size", F.posexplode("keys").alias("band", "key")).withColumn("part", F.col("node"))
    active = materialise(_open(entries))
    active = materialise(active.join(active.groupBy("node").agg(F.sum("n").alias("sum")), "node"))
    # texts of those alone, by one join at every size; their tables grow with the input, so neither is broadcast
    own = nodes.select(F.col("node").alias("doc_id"), "digest").join(active.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = signed.select("doc_id", "digest", "size", "bits", "packed").hint("merge").join(own, ["doc_id", "digest"], "left_semi")
    texts = materialise(texts.groupBy(F.col("doc_id").alias("node"), "digest").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("packed").alias("packed")).drop("digest"))
    pairs = materialise(_possible(_led(active, threshold).distinct(), texts, threshold))
    roots = materialise(connected(_verify(pairs, texts, threshold)))

    # what is left of the groups
    open_ = materialise(_open(_renamed(active.drop("part", "n"), roots, "node", "part")))
    large = materialise(open_.where(F.col("n") > SMALL).drop("n"))
    second = large.select(F.col("node").alias("n2"), F.col("band").alias("b2"), F.col("key").alias("k2"))
    split = large.join(second, (F.col("node") == F.col("n2")) & (F.col("band") < F.col("b2")))
    split = materialise(_open(split.select("node", "size", "sum", "part", (F.col("band") * KEYS + F.col("b2")).alias("band"), F.xxhash64("key", "k2").alias("key"))))
    tried = _pairs(open_.where(F.col("n") <= SMALL), threshold).union(_pairs(split.where(F.col("n") <= SMALL), threshold)).union(_led(split.where(F.col("n") > SMALL), threshold))
    tried = materialise(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    likely = materialise(_possible(tried, texts, threshold))
    links = materialise(_verify(likely, texts, threshold))
    between = _renamed(_renamed(links, roots, "a", "a"), roots, "b", "b")
    roots2 = materialise(connected(between))
    discard(active, pairs, open_, split, tried, likely)

    # all that is left of the large groups
    rest = materialise(_open(_renamed(large, roots2, "part", "part")))
    far = materialise(_rest(rest, texts, threshold).distinct())
    links3 = materialise(_verify(far, texts, threshold))
    between = _renamed(_renamed(_renamed(_renamed(links3, roots, "a", "a"), roots2, "a", "a"), roots, "b", "b"), roots2, "b", "b")
    roots3 = materialise(connected(between))
    discard(large, rest, far, links3, texts)

    to = _renamed(_renamed(_renamed(firsts, roots, "node", "class_id"), roots2, "class_id", "class_id"), roots3, "class_id", "class_id").where((F.col("copies") > 1) | (F.col("class_id") != F.col("node")))
    to = materialise(to.select("digest", "class_id"))
    classes = materialise(signed.select("doc_id", "digest").join(to, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    discard(signed, firsts, nodes, roots, links, roots2, roots3, to)
    mine = unused_name(docs, "mine")
    joined = docs.join(classes.withColumnRenamed("doc_id", mine), F.col(doc_id).cast("bigint") == F.col(mine), "left").drop(mine)
    joined = joined.withColumn("class_id", F.coalesce("class_id", F.col(doc_id).cast("bigint")))
    return joined.withColumn("kept", F.coalesce(F.col("class_id") == F.col(doc_id), F.lit(True)))
