"""Byte-level BPE: encoding by a contiguous rank array, decoding by concatenation.

Each word is held as two arrays side by side: the boundaries of its parts and, for each pair of
neighbours, the rank of their union. The smallest rank is found by a scan, the boundary between its
two parts is deleted, and the ranks on both sides are looked up anew. Words are short, so the scans
beat any heap; a word above ``LONG`` bytes takes a heap with links instead, which keeps very long
runs near linear.

Edge cases: null text counts as empty and gives no ids; ids outside the vocabulary raise ValueError
in decoding; invalid UTF-8 decodes to U+FFFD; repeated rows each get their ids, and an empty table gives an empty one.
Columns other than the text pass through unchanged; one that has an added name in any case raises ValueError.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridweave.llm.common import HELD, release
from gridweave.llm.memo import ChunkEncoder

#: The published split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes above which a word takes the heap.
LONG = 256
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankBPE:
    """A vocabulary file read into ranks; encodes and decodes single texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.id_of = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {to_bytes(a + b): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text in self.special:
            self.id_of.pop(text.encode(), None)
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = ChunkEncoder(self._encode_chunks, blank_matters=True)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if len(word) > LONG:
            return self._merge_long(word)
        get = self.rank.get
        bounds = list(range(len(word) + 1))
        ranks = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                ranks[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
        return [self.id_of[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        n, get = len(word), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or after[j] != end:
                continue
            live[j], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := get(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := get(word[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(self.id_of[word[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for word in self.split.findall(part):
                    ids += self.merge(word.encode())
        return ids

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return [array("I", self.encode(c)).tobytes() for c in chunks]

    def decode_bytes(self, ids) -> bytes:
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except (IndexError, TypeError):
            raise ValueError("an id is not in the vocabulary") from None

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, RankBPE] = {}
HELD.append(_LOADED)


def load(path: str) -> RankBPE:
    """One per Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = RankBPE(path)
    return _LOADED[path]


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the column ``text`` by ``ids``: binary, little-endian unsigned 32-bit ids. No shuffle."""
    if ids.lower() in {c.lower() for c in df.columns if c != text}:
        raise ValueError(f"column {ids} exists")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            keep = [c for c in batch.schema.names if c != text]
            for first, flat, at in bpe.chunks.slices(batch.column(text)):
                packed, bounds = flat.tobytes(), (4 * at).tolist()
                part = batch.slice(first, len(at) - 1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([packed[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary())], names=[*keep, ids])

    return df.mapInArrow(run, f"{fields}{', ' if fields else ''}`{ids}` binary")


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text`` decoded from packed ``ids`` (null: empty). No shuffle."""
    if text.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {text} exists")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # a worker that encoded before holds a memo
        bpe = load(vocabulary)
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, len(whole), 512)):
            texts = [bpe.decode(memoryview(x or b"").cast("I")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, f"{fields}, `{text}` string")
