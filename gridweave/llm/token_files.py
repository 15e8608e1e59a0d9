"""Token ids in directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of each id that
has one, a bitmap with one bit for each of them says whether the id goes on in level k+1, and a rank
directory counts the bits before each 512th. So the chunk of token i is at i in level 0, and at the
rank of i in the next level: any token is read without decoding its block.

A file is a Parquet table of blocks ``shard, place, first_doc, last_doc, doc_ids, starts, n_ids, codes``: a shard is what
one task wrote, ``place`` counts the ids before the block in its shard, both ascend by document, ``starts``
has each document's first place in its block and ``codes`` the levels. Pages aren't compressed, so the levels stand in the file
as they are read; ``token_at`` finds a block by its first and last document and reads one token in it. A block ends with the
document that takes it past ``BLOCK_IDS`` ids, so memory is bounded by that and the longest document.

Edge cases: null text counts as empty and has the end id alone; a null doc_id sorts first; rows with
one doc_id stay apart, in the order of a hash of their texts; an empty table gives an empty file; other columns aren't written.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.llm.common import HELD, halved, uncollected
from gridweave.llm.memo import ChunkEncoder

BLOCK_IDS = 1 << 18
#: Bits from one rank directory entry to the next.
RANK_BITS = 512
#: Words that the library encodes as one text.
TOGETHER = 256
#: Words that ``write_tokens`` remembers, also from task to task; it bounds memory, never results.
REMEMBERED = 1_200_000
_LENGTH = struct.Struct("<I")
FILE_SCHEMA = "shard int, place bigint, first_doc bigint, last_doc bigint, doc_ids array<bigint>, starts array<int>, n_ids int, codes binary"


def encode_levels(ids: np.ndarray) -> bytes:
    """One block: for each level its number of chunks, the chunks, the bitmap and the rank directory."""
    rest, out = np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
        rank = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        out += [_LENGTH.pack(len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), padded.tobytes(), rank.tobytes()]
        if not more.any():
            return b"".join(out)
        rest = rest[more] >> 8


class Levels:
    """Reads a block in place."""

    def __init__(self, codes: bytes):
        self.levels, at = [], 0
        while at < len(codes):
            (n,) = _LENGTH.unpack_from(codes, at)
            at += 4
            blocks = -(-n // RANK_BITS)
            chunks = np.frombuffer(codes, np.uint8, n, at)
            bits = np.frombuffer(codes, np.uint8, blocks * RANK_BITS // 8, at + n)
            rank = np.frombuffer(codes, "<u4", blocks, at + n + len(bits))
            at += n + len(bits) + 4 * blocks
            self.levels.append((chunks, bits, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """Token i: one chunk, one bit and at most one rank for each of its levels."""
        value = 0
        for k, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BITS * RANK_BITS // 8
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & (1 << (i & 7)) - 1).bit_count()
            i = int(rank[i // RANK_BITS]) + before
        return value

    def all(self) -> np.ndarray:
        """All ids of the block."""
        out = np.zeros(len(self), np.uint32)
        where: np.ndarray | slice = slice(None)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            where = np.flatnonzero(more) if k == 0 else where[more]
        return out


_LOADED: dict[str, ChunkEncoder] = {}
HELD.append(_LOADED)


def library_encoder(vocabulary: str, blank_matters: bool, limit: int = 400_000) -> ChunkEncoder:
    """The tokenizers library behind the memo of ``limit`` words; one per Python worker and file."""
    if vocabulary not in _LOADED:
        # a task has one core; threads that wait for words this short cost more than they do
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(vocabulary)
        lib.no_truncation()
        lib.no_padding()

        def many(chunks: list[str]) -> list[bytes]:
            ids = [e.ids for e in lib.encode_batch_fast(chunks, add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, ids)]) * 4
            packed = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
            return [packed[a:b] for a, b in pairwise(ends.tolist())]

        suffix = getattr(lib.model, "end_of_word_suffix", None)
        edge = np.zeros(lib.get_vocab_size(), bool)  # tokens that a word ends with, or that begin with the space before it
        for token, i in lib.get_vocab().items():
            edge[i] = token.endswith(suffix) if suffix else token.startswith("\u0120")

        def words(chunks: list[str]) -> list[bytes]:
            own = [c for c in chunks if c[0] == " "] if blank_matters else chunks if suffix else []
            rows = [own[k : k + TOGETHER] for k in range(0, len(own), TOGETHER)]
            found: dict[str, bytes] = {}
            for row, e in zip(rows, lib.encode_batch_fast([("" if blank_matters else " ").join(r) for r in rows], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(edge[ids])
                at = [0, *(4 * at + 4).tolist()] if suffix else [*(4 * at).tolist(), 4 * len(ids)]
                if len(at) == len(row) + 1 and at[0] == 0 and at[-1] == 4 * len(ids):  # else a word has an unknown letter: all by themselves
                    packed = ids.tobytes()
                    found.update(zip(row, [packed[x:y] for x, y in pairwise(at)]))
            rest = [c for c in chunks if c not in found]
            found.update(zip(rest, many(rest)))
            return [*map(found.__getitem__, chunks)]

        _LOADED[vocabulary] = ChunkEncoder(many, blank_matters=blank_matters, encode_words=words)
    for memo in _LOADED[vocabulary].memos:
        memo.limit = limit
    return _LOADED[vocabulary]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode each text, append ``end_id`` and write all ids to ``path`` in ascending ``doc_id`` order.

    One range shuffle of the texts; they are encoded after it, since ids take more room than text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, place = library_encoder(vocabulary, True, REMEMBERED), TaskContext.get().partitionId(), 0
        names: list = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            ids = np.concatenate(parts)
            row = [[shard], [place], [names[0]], [names[-1]], [names], [[0, *ends[:-1].tolist()]], [len(ids)], [encode_levels(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary()))], names=["shard", "place", "first_doc", "last_doc", "doc_ids", "starts", "n_ids", "codes"])

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, ids, at in encoder.slices(batch.column(1), end_id):
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    names.append(ids_of[first + k])
                    parts.append(ids[a:b])
                    size += b - a
                    if size >= BLOCK_IDS:
                        yield flush()
                        names, parts, size, place = [], [], 0, place + int(size)
        if names:
            yield flush()

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("nth", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth").select("doc_id", "text")
    ordered.mapInArrow(halved(uncollected(run), lambda: []), FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def token_at(spark: SparkSession, path: str, doc_id: int, position: int) -> int:
    """The id at a position of a document, read from its block without decoding it; of several rows with the id, from the first. IndexError beyond its end."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id) & F.array_contains("doc_ids", doc_id))
    row = blocks.orderBy("shard", "place").select("doc_ids", "starts", "n_ids", "codes").first()  # one block
    if row is None:
        raise KeyError(doc_id)
    k = row.doc_ids.index(doc_id)
    start, end = row.starts[k], row.starts[k + 1] if k + 1 < len(row.starts) else row.n_ids
    if not 0 <= position < end - start:
        raise IndexError(position)
    return Levels(bytes(row.codes)).token(start + position)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document of a file: shard, at (ids before it in its shard), doc_id, n_tokens, ids (packed). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = Levels(row["codes"]).all().astype("<u4"), len(row["doc_ids"])
                cuts = np.array([*row["starts"], len(ids)])
                columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["place"] + cuts[:-1], pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "at", "doc_id", "n_tokens", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(run, "shard int, at bigint, doc_id bigint, n_tokens bigint, ids binary")


def with_starts(docs: DataFrame, path: str) -> DataFrame:
    """Replace ``shard, at`` by ``start``, the ids of all documents before. Project ``docs`` to what is needed first.

    The sum runs over the shards, of which there are as many as tasks that wrote, not over documents.
    """
    files = docs.sparkSession.read.schema(FILE_SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum(F.col("n_ids").cast("bigint")).alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(shards, "shard").withColumn("start", F.col("before") + F.col("at")).drop("shard", "at", "before")
