"""Encoding text word by word with a bounded memo.

A token of either vocabulary never reaches from a visible character into the blanks after it, so a
text may be cut there and its parts be encoded apart; results equal those for whole texts. Words
repeat: each batch is cut and its distinct words are found by Arrow, most of those are looked up, only
new ones are encoded, and the ids are laid out by numpy. A new word of common letters with signs behind it is put together
from both, which other words share.

Edge cases: null counts as empty; a text above ``step`` bytes is laid out by itself, in memory that grows with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What str.isspace() calls blank, for Arrow.
_BLANK = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
#: Cuts before a certain blank that follows what is certainly visible.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
#: At most one break, letters that both vocabularies' patterns keep together, with a space before them or not, and signs, which they keep apart from these.
_SIMPLE = r"^(?P<blank>\n?)(?P<letters> ?[A-Za-zÀ-ÖØ-öø-į]+)(?P<signs>[!-/:-@\[-`{-~]*)$"


class Memo:
    """A mapping of bounded size: when the newer half is full, the older one is dropped; what is asked for moves to the newer."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get_all(self, keys: list[str]) -> list[bytes | None]:
        found = [*map(self.new.get, keys)]
        if self.old and None in found:
            away = [i for i, value in enumerate(found) if value is None]
            for i, value in zip(away, map(self.old.get, map(keys.__getitem__, away))):
                if value is not None:
                    found[i] = self.new[keys[i]] = value
        return found

    def trim(self) -> None:
        if len(self.new) > self.limit // 2:
            self.old, self.new = self.new, {}


class ChunkEncoder:
    """Encode texts to 32-bit ids.

    encode_many: encodes a list of chunks, each with its leading blanks, to packed little-endian ids.
    blank_matters: whether a word after a space encodes differently from the word alone.
    encode_words: the same for chunks of common letters, with a space before them or not; by default encode_many.
    limit: words that are remembered; bounds memory, never results.
    step: bytes of text that are laid out at a time.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], *, blank_matters: bool, encode_words: Callable[[list[str]], list[bytes]] | None = None, limit: int = 400_000, step: int = 3 << 20):
        self.encode_many, self.encode_words, self.step = encode_many, encode_words or encode_many, step
        self.lead = " " if blank_matters else ""
        self.words = Memo(limit)  # without the space before it
        self.pieces = Memo(limit)
        self.memos = [self.words, self.pieces]

    def slices(self, texts: pa.Array, tail: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Ids of consecutive texts, about ``step`` bytes at a time: first row, ids, and where each text starts and the last ends.

        ``tail``: an id to append to each text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + self.step, "right")))
            ids, offsets = self._encode(texts.slice(lo, hi - lo))
            if tail is not None:
                ids = np.insert(ids, offsets[1:], tail)
                offsets = offsets + np.arange(len(offsets))
            yield lo, ids, offsets
            lo = hi

    def encode(self, texts: list[str | None] | pa.Array, tail: int | None = None) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        out = []
        for _, ids, at in self.slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), tail):
            packed, at = ids.tobytes(), (4 * at).tolist()
            out += [packed[a:b] for a, b in zip(at, at[1:])]
        return out

    def _look(self, pieces: list[str], letters: bool = False) -> list[bytes]:
        """Packed ids of different pieces; ``letters``: each is a chunk for encode_words."""
        found = self.pieces.get_all(pieces)
        fresh = [i for i, ids in enumerate(found) if ids is None]
        if fresh:
            for i, ids in zip(fresh, (self.encode_words if letters else self.encode_many)([pieces[i] for i in fresh])):
                found[i] = self.pieces.new[pieces[i]] = ids
        return found

    def _resolve(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks with their leading blanks; a simple chunk is its parts one by one."""
        found = pc.extract_regex(pa.array(chunks, pa.large_string()), _SIMPLE)
        simple = found.is_valid().to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(chunks)
        odd = np.flatnonzero(~simple).tolist()
        for i, ids in zip(odd, self._look([chunks[i] for i in odd])):
            out[i] = ids
        found = found.filter(pa.array(simple)).flatten()
        if not self.lead:  # blanks have no ids, and capitals none of their own
            found = [found[0], pc.utf8_ltrim(pc.utf8_lower(found[1]), " "), found[2]]
        parts = []
        for part, letters in [*zip(found, (False, True, False))][0 if self.lead else 1 :]:
            coded = part.dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if names == [""]:
                continue
            ids = dict(zip(some := [n for n in names if n], self._look(some, letters)))
            parts.append(np.array([ids.get(n, b"") for n in names], object)[coded.indices.to_numpy(zero_copy_only=False)].tolist())
        for i, ids in zip(np.flatnonzero(simple).tolist(), map(b"".join, zip(*parts)) if len(parts) > 1 else chain(*parts)):
            out[i] = ids
        return out

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self.words.trim()
        self.pieces.trim()
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.words.get_all(words)
        blank = pc.or_(pc.equal(coded.dictionary, ""), pc.match_substring_regex(coded.dictionary, _BLANK)).to_numpy(zero_copy_only=False)
        odd = [i for i in np.flatnonzero(blank).tolist() if known[i] is None]
        first = offsets[:-1]
        runs = [i for i in odd if not words[i] or words[i][-1].isspace()]  # a run of blanks belongs together
        whole = np.zeros(len(texts), bool)
        if runs:
            hit = np.isin(index, runs)
            if "" in words:
                hit[first[index[first] == words.index("")]] = False  # a single space that opens a text
            whole[np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1] = True
        cuts = {i: _CUT.split(self.lead + words[i]) for i in set(odd).difference(runs)}
        alone = []  # what opens a text has no space before it
        for row in range(len(texts)):
            text = texts[row].as_py() if whole[row] else words[index[first[row]]]
            alone.append(_CUT.split(text) if text else [])
        plain = [i for i, (ids, parted) in enumerate(zip(known, blank.tolist())) if ids is None and not parted]
        rest = list({c for cs in (*cuts.values(), *alone) for c in cs})
        found = self._resolve([*(self.lead + words[i] for i in plain), *rest])
        for i, ids in zip(plain, found):
            known[i] = self.words.new[words[i]] = ids
        chunks = dict(zip(rest, found[len(plain) :]))
        joined = lambda cs: b"".join([chunks[c] for c in cs])
        for i in odd:
            known[i] = joined(cuts[i]) if i in cuts else b""
        known += map(joined, alone)
        index[first] = len(words) + np.arange(len(texts))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(known), "<u4")
        size = sizes[index]
        if whole.any():
            keep = ~np.repeat(whole, np.diff(offsets))
            keep[first] = True
            size = np.where(keep, size, 0)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[index] - ends + size, size)
        at += np.arange(total)
        return flat[at], np.concatenate([[0], ends[offsets[1:] - 1]]).astype(np.int64)
