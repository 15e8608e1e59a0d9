"""Language of each word, and from them of each text, by a linear-chain conditional random field.

A word's features are its beginning and end (1 to 3 letters), its trigrams and, if it stands ``OFTEN`` times in the sample, itself.
Weights of features and of transitions between the languages of neighbouring words are learned together by
maximising the conditional likelihood of the training words' languages (forward-backward gives the gradient).
A text's words are labelled by forward-backward as well, so a foreign passage inside a text is seen as such; the text's
language is the one with the greatest expected number of words, and the score is its share.

Texts run side by side in blocks of ``_BLOCK`` words, one step for each place in a block, so the work is in numpy whatever the lengths;
at most ``_STEP`` characters are held as words at a time, or one text.
Training takes at most ``max_runs`` runs of words, chosen by hash so that rare languages get more than their share. Every
text of a known language is cut into runs of about ``RUN`` bytes (one for each ``RUN`` bytes begun, equal in words), and all
runs of all texts stand to be chosen; prediction reads whole texts. The languages are those of
whole texts, so no change of language is seen in training: what a change costs comes from the pull of its weight to 0.

What part of a word's features was learned tells whether the model knows such words at all; ``known`` is the mean of it over
a text's words with letters. ``model.least`` is half of the least that a training run has: below it, the languages that were
learned say nothing about a text, and a filter may reject it.

Edge cases: text that is null or has no letter (Unicode category L), or nothing to learn from, gives ``und`` and score 0; words
without a letter carry no evidence; ties go to the language that is first in order; equal rows teach once, different
rows of one id each; texts of any length are read whole; columns named like the added ones raise ValueError; repeated rows
each get their answer, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import give_back, held_out, tidy

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
OFTEN = 3
#: Bytes of text for each run of words that may teach.
RUN = 1500
_MEMO_LIMIT = 150_000
_STEP = 500_000


def core(word: str) -> str:
    """The lower-case letters of a word; its own core is itself."""
    low = word.lower()
    return low if low.isalpha() else "".join(_LETTER.findall(low))


def features(word: str) -> list[str]:
    """Of a run of visible characters; none without letters."""
    w = core(word)
    if not w:
        return []
    head, tail, padded = f"^{w}", f"{w}$", f"^{w}$"
    return [f"={w}", head[:2], head[:3], head[:4], tail[-2:], tail[-3:], tail[-4:], *[padded[i : i + 3] for i in range(len(padded) - 2)]]


@dataclass
class Model:
    languages: list[str]
    at: dict[str, int]  # features
    weights: np.ndarray  # features, languages
    moves: np.ndarray  # languages, languages
    prior: np.ndarray
    least: float = 0.0  # half of the least part of known features in a training run


def _forward_backward(emit: np.ndarray, lengths: np.ndarray, model_moves: np.ndarray, prior: np.ndarray, pairs: bool = False):
    """Marginals of each word's language; sequences lie one after another in ``emit``, all run side by side.

    With ``pairs`` also the expected number of each transition and the log likelihood's normaliser.
    """
    n, k = emit.shape
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    top = emit.max(1, keepdims=True)
    likely = np.exp(emit - top)
    move, first = np.exp(model_moves), np.exp(prior)
    alpha, scale = np.empty_like(likely), np.empty(n)
    prev = None
    for t in range(longest):
        rows = start[: alive[t]] + t
        a = likely[rows] * (first if prev is None else prev[: alive[t]] @ move)
        s = a.sum(1)
        prev = a / s[:, None]
        alpha[rows], scale[rows] = prev, s
    gamma, counts = np.empty_like(likely), np.zeros((k, k))
    beta = np.ones((alive[0] if longest else 0, k))
    for t in range(longest - 1, -1, -1):
        rows = start[: alive[t]] + t
        b = beta[: alive[t]]
        g = alpha[rows] * b
        gamma[rows] = g / g.sum(1, keepdims=True)
        back = likely[rows] * b / scale[rows][:, None]
        if pairs and t:
            counts += (alpha[rows - 1].T @ back) * move
        beta[: alive[t]] = back @ move.T
    return (gamma, counts, float(np.log(scale).sum() + top.sum())) if pairs else gamma


def train(docs: DataFrame, max_runs: int = 1500, steps: int = 40) -> Model:
    """Learn from texts and languages of rows whose id isn't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    each = known.select("doc_id", "lang", F.xxhash64("text").alias("same"), F.expr(f"1 + octet_length(text) div {RUN}").alias("runs")).distinct()
    often = each.groupBy("lang").agg(F.sum("runs").alias("often"))
    place = F.pmod(F.xxhash64("doc_id", "same", "run"), F.lit(1 << 40)) / float(1 << 40)
    cut = each.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("runs") - 1)).alias("run"))
    chosen = cut.join(often, "lang").orderBy(place * F.sqrt("often"), "doc_id", "lang", "same", "run").limit(max_runs)
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("tongue"), F.col("same").alias("code"), "runs", "run")
    # at most max_runs short rows; of each text its chosen runs come
    words = F.filter(F.split(F.translate("text", "\t\n\r\x0b\x0c", "     "), " "), lambda w: w != "")
    rows = known.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("tongue")) & (F.xxhash64("text") == F.col("code"))).withColumn("words", words)
    bound = lambda n: F.expr(f"cast(size(words) * {n} div runs as int)")
    rows = rows.select("id", "tongue", "code", "run", F.slice("words", bound("run") + 1, bound("(run + 1)") - bound("run")).alias("words"))
    rows = rows.dropDuplicates(["id", "tongue", "code", "run"]).select("tongue", "words").collect()
    rows = sorted(((r.tongue, [w for w in r.words if _LETTER.search(w)]) for r in rows), key=lambda r: (r[0], r[1]))
    rows = [r for r in rows if r[1]]
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    words = sorted({w for _, ws in rows for w in ws})
    number = {w: i for i, w in enumerate(words)}
    found, times = [features(w) for w in words], Counter(f"={core(w)}" for _, ws in rows for w in ws)
    shared = Counter(f for fs in found for f in fs)  # parts that different words have, and words that stand often
    at = {f: i for i, f in enumerate(sorted(f for f, n in shared.items() if (times[f] >= OFTEN if f[0] == "=" else n > 1)))}
    model = Model(languages, at, np.zeros((len(at), k)), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not at:
        return model
    flat = np.array([at[f] for fs in found for f in fs if f in at], np.int64)
    owner = np.array([i for i, fs in enumerate(found) for f in fs if f in at], np.int64)
    index = np.array([number[w] for _, ws in rows for w in ws])
    lengths = np.array([len(ws) for _, ws in rows])
    gold = np.repeat([languages.index(lang) for lang, _ in rows], lengths)
    truth = np.eye(k)[gold]
    rare = np.bincount(gold, minlength=k).astype(float)
    seen_moves = np.diag(np.bincount(np.repeat([languages.index(lang) for lang, _ in rows], lengths - 1), minlength=k).astype(float))
    total = len(gold)
    scatter = lambda values, by, size: np.stack([np.bincount(by, values[:, c], size) for c in range(k)], 1)
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.moves)]
    for _ in range(steps):
        emit = scatter(model.weights[flat], owner, len(words))[index]
        gamma, counts, _ = _forward_backward(emit, lengths, model.moves, model.prior, pairs=True)
        by_word = scatter(truth - gamma, index, len(words))
        grads = [scatter(by_word[owner], flat, len(at)) / total - 1e-6 * model.weights, (seen_moves - counts) / total - 1e-3 * model.moves]
        for value, grad, square in zip((model.weights, model.moves), grads, squares):
            square += grad * grad
            value += 0.5 * grad / np.sqrt(square)
    share = np.array([len([f for f in fs if f in at]) / max(1, len(fs)) for fs in found])[index]
    model.least = float((np.add.reduceat(share, np.cumsum(lengths) - lengths) / lengths).min()) / 2
    model.prior = np.log((rare + 1) / (rare + 1).sum())
    del rows, found, flat, owner, index
    give_back()
    return model


#: Words that a block of a text has, and places after which products of such blocks are scaled anew.
_BLOCK, _SCALE = 64, 8


def _marginals(table: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, model_moves: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """``_forward_backward`` of the logarithms of ``table[numbers]``, with blocks of all texts side by side, so that no step is for one place of one long text.

    The product of a block's moves and evidence carries what is known before it to its end and what is known after it to its
    beginning; from these, places inside of all blocks follow at once.
    """
    k, move, first = table.shape[1], np.exp(model_moves), np.exp(prior)
    per = -(-lengths // _BLOCK)
    number = np.cumsum(per) - per  # of a text's first block
    text = np.repeat(np.arange(len(lengths)), per)
    before = (np.arange(len(text)) - number[text]) * _BLOCK
    size = np.minimum(lengths[text] - before, _BLOCK)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    start, size = ((np.cumsum(lengths) - lengths)[text] + before)[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), "right")
    ends = np.cumsum(alive).tolist()
    steps = [slice(end - n, end) for n, end in zip(alive.tolist(), ends)]
    at = np.concatenate([start[:n] + t for t, n in enumerate(alive)] or [start])
    likely = np.ascontiguousarray(table[numbers[at]].T)  # by place in a block; a row for each language
    begin, end = np.empty((k, len(order))), np.ones((k, len(order)))
    begin[:] = first[:, None]
    by_blocks = np.argsort(-per, kind="stable")
    going = np.searchsorted(-per[by_blocks], -np.arange(1, int(per.max(initial=0)) + 1), "right")
    if len(going) > 1:
        product = np.eye(k)[:, :, None] * likely[:, : len(order)]
        for t, (n, own) in enumerate(zip(alive.tolist(), steps)):
            if t:
                product[:, :, :n] = np.matmul(move.T, product[:, :, :n]) * likely[:, own]
            if t % _SCALE == _SCALE - 1:
                product[:, :, :n] /= product[:, :, :n].max((0, 1))
        for s, n in enumerate(going[1:].tolist()):
            b = place[number[by_blocks[:n]] + s]
            x = move.T @ np.einsum("in,ijn->jn", begin[:, b], product[:, :, b])
            begin[:, place[number[by_blocks[:n]] + s + 1]] = x / x.sum(0)
        for s in range(len(going) - 1, 0, -1):
            b = place[number[by_blocks[: going[s]]] + s]
            x = move @ np.einsum("ijn,jn->in", product[:, :, b], end[:, b])
            end[:, place[number[by_blocks[: going[s]]] + s - 1]] = x / x.sum(0)
        del product
    alpha, x = np.empty_like(likely), begin
    for n, own in zip(alive.tolist(), steps):
        a = likely[:, own] * x[:, :n]
        a /= a.sum(0)
        alpha[:, own] = a
        x = move.T @ a
    for n, own in zip(alive[::-1].tolist(), steps[::-1]):
        b = end[:, :n]
        g = alpha[:, own] * b
        g /= g.sum(0)
        alpha[:, own] = g
        b = move @ (likely[:, own] * b)
        end[:, :n] = b / b.sum(0)
    gamma = np.empty((len(at), k))
    gamma[at] = alpha.T
    return gamma


@cache
def _letters() -> np.ndarray:
    """Of each code point: whether it is a letter."""
    out = np.zeros(0x110000, bool)
    out[[*map(ord, _LETTER.findall("".join(map(chr, range(0x110000)))))]] = True
    return out


#: Above all code points, so that three of them make one number.
_BASE = 0x110000


def _key(feature: str) -> int:
    """A number for the beginning, end or trigram ``feature``: of its letters, and of which of the two it is if it has four signs."""
    kind = 0 if len(feature) < 4 else 1 if feature[0] == "^" else 2
    out = kind
    for c in (feature if not kind else feature[1:] if kind == 1 else feature[:-1]).rjust(3, "\0"):
        out = out * _BASE + ord(c)
    return out


class Tagger:
    """Marginals for batches of texts; the evidence of each word is computed once, of all new words at once."""

    def __init__(self, model: Model):
        self.model = model
        k = len(model.languages)
        # the last row is for features that weren't learned, the last column counts those that were
        self.weights = np.concatenate([np.concatenate([model.weights, np.zeros((1, k))]), np.ones((len(model.weights) + 1, 1))], 1)
        self.weights[-1] = 0
        self.words = {f[1:]: i for f, i in model.at.items() if f[0] == "="}
        coded = sorted((_key(f), i) for f, i in model.at.items() if f[0] != "=")
        self.keys = np.array([c for c, _ in coded] + [np.iinfo(np.int64).max], np.int64)
        self.places = np.array([i for _, i in coded] + [len(model.weights)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.memo, self.size = {"": 0}, 1
        self.rows = [np.ones((1, len(self.model.languages)))]  # likelihoods, the greatest of each row 1
        self.parts = [np.full(1, np.nan)]  # what part of the features of each row was learned

    def _sums(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return self.weights[np.where(self.keys[at] == keys, self.places[at], len(self.weights) - 1)]

    def _learn(self, fresh: list[str]) -> None:
        """Rows for new words: the sums over ``features`` of each."""
        codes = np.frombuffer("\n".join([*fresh, ""]).lower().encode("utf-32-le"), "<u4")
        cores = codes[_letters()[codes] | (codes == 10)].tobytes().decode("utf-32-le")
        names = cores.split("\n")[:-1]
        signs = np.frombuffer(("^" + cores.replace("\n", "$^")).encode("utf-32-le"), "<u4").astype(np.int64)[:-1]
        n = np.fromiter(map(len, names), np.int64, len(names))
        some = np.flatnonzero(n)
        self.memo.update(dict.fromkeys(map(fresh.__getitem__, np.flatnonzero(n == 0).tolist()), 0))
        if not len(some):
            return
        first, n = (np.cumsum(n + 2) - n - 2)[some], n[some]
        last = first + n + 1
        three = (signs[:-2] * _BASE + signs[1:-1]) * _BASE + signs[2:]
        inner = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.add.reduceat(self._sums(three[inner]), np.cumsum(n) - n)
        sums += self.weights[np.fromiter(map(self.words.get, map(names.__getitem__, some.tolist()), repeat(len(self.weights) - 1)), np.int64, len(some))]
        for kind, two, end, inside in ((1, first, first, first + 1), (2, last - 1, last - 2, last - 3)):
            pair = signs[two] * _BASE + signs[two + 1]
            triple = np.where(n > 1, three[end], pair)
            for keys in (pair, triple, np.where(n > 2, kind * _BASE**3 + three[np.clip(inside, 0, len(three) - 1)], triple)):
                sums += self._sums(keys)
        self.parts.append(sums[:, -1] / (n + 7))
        likely = sums[:, :-1]
        self.rows.append(np.exp(likely - likely.max(1, keepdims=True)))
        self.memo.update(zip(map(fresh.__getitem__, some.tolist()), range(self.size, self.size + len(some))))
        self.size += len(some)

    def evidence(self, words: list[str]) -> np.ndarray:
        """Row numbers into ``rows`` for the words; 0 for those without evidence."""
        fresh = list(set(words).difference(self.memo))
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def tag(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, float]]:
        """All words of each text, their marginals, and what part of their features is known; marginals of words without a letter follow from the words beside them."""
        if len(self.memo) > _MEMO_LIMIT:
            self.forget()
        split = [(t or "").split() for t in texts]
        numbers = self.evidence([w for ws in split for w in ws])
        if len(self.rows) > 1:
            self.rows, self.parts = [np.concatenate(self.rows)], [np.concatenate(self.parts)]
        lengths = np.array([len(ws) for ws in split], np.int64)
        gamma = _marginals(self.rows[0], numbers, lengths, self.model.moves, self.model.prior)
        ends = np.cumsum(lengths)
        parts = self.parts[0][numbers]
        worded, owner = ~np.isnan(parts), np.repeat(np.arange(len(split)), lengths)
        have = np.bincount(owner, np.where(worded, parts, 0), len(split)) / np.maximum(np.bincount(owner, worded, len(split)), 1)
        return [(ws, gamma[e - len(ws) : e], part) for ws, e, part in zip(split, ends, have.tolist())]


def _by_length(texts: pa.Array) -> Iterator[np.ndarray]:
    """Places of all texts, shortest first, in runs of at most ``_STEP`` characters or one text."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _STEP, "right")))
        yield order[lo:hi]
        lo = hi


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score, shares (expected share of words by language) and known (part of the features that was learned) to each row of ``docs``. No shuffle."""
    added = ["lang_pred", "score", "shares", "known"]
    clash = set(added) & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    # bounded by max_runs * RUN bytes of words on average and their features
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tagger = Tagger(own)
        for batch in batches:
            texts = batch.column(text)
            names, scores, shares, parts = [UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts), [0.0] * len(texts)
            for places in _by_length(texts) if own.languages else ():
                part = texts.take(pa.array(places)).to_pylist()
                for k, body, (_, gamma, have) in zip(places.tolist(), part, tagger.tag(part)):
                    if not body or not _LETTER.search(body):
                        continue
                    mean = gamma.mean(0)
                    names[k] = own.languages[int(mean.argmax())]
                    scores[k] = min(1.0, float(mean.max()))
                    parts[k] = have
                    shares[k] = [(lang, float(x)) for lang, x in zip(own.languages, mean)]
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64())), pa.array(parts, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return docs.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double, shares map<string,double>, known double")
