import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from gridweave.llm import packing as K
from gridweave.llm import token_files as T
from gridweave.llm.common import shared_dir
from tests.llm.test_bpe import ODD, random_texts


@pytest.mark.parametrize("ids", [[], [0], [255], [256], [65535, 65536, 0, 1 << 31, 2**32 - 1], list(range(0, 200_000, 37))])
def test_levels(ids):
    block = T.Levels(T.encode_levels(np.array(ids, np.uint32)))
    assert block.all().tolist() == ids
    for i in random.Random(1).sample(range(len(ids)), min(len(ids), 300)):
        assert block.token(i) == ids[i]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_library(name):
    lib = Tokenizer.from_file(P.path(name))
    texts = [*ODD, *random_texts(2000, 5), "ΑΣ ΑΣ. Σ", "İx ǅ", "a ̈ b"]
    enc = T.ChunkEncoder(lambda cs: [array("I", e.ids).tobytes() for e in lib.encode_batch(cs, add_special_tokens=False)], blank_matters=name[0] == "b")
    for _ in range(2):
        assert [list(array("I", x)) for x in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_equal_library(name):
    """Letters, signs and breaks in all orders, with capitals and accents, again after the memo was halved."""
    rng = random.Random(11)
    bits = ["Word", "ÀÉîß", "ıİĮ", "don't", "'s", "'LL", "...", "--", "_", "###", "%)", "7", "²", "<|endoftext|>", "x<|", "\n", "\n\n", " ", "  ", "\t", "\u00a0", "e\u0301", "ΟΔΟΣ", "ﬁ", "\x1c", "Ķi"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    lib = Tokenizer.from_file(P.path(name))
    enc = T.library_encoder(P.path(name), name[0] == "b")
    small = T.ChunkEncoder(enc.encode_many, blank_matters=name[0] == "b", limit=200, step=2000)
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
    for e in (enc, small, small):
        assert [list(array("I", x)) for x in e.encode(texts)] == want


def test_token_at(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 64)
    path = shared_dir(spark)
    rows = [(d, " ".join(f"w{d * k}" for k in range(d % 37))) for d in range(90)]
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, P.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d in (0, 1, 36, 50, 89):
        ids = [*lib.encode(rows[d][1], add_special_tokens=False).ids, 2]
        assert [T.token_at(spark, path, d, i) for i in (0, len(ids) // 2, len(ids) - 1)] == [ids[i] for i in (0, len(ids) // 2, len(ids) - 1)]
        with pytest.raises(IndexError):
            T.token_at(spark, path, d, len(ids))
    with pytest.raises(KeyError):
        T.token_at(spark, path, 900, 0)


def test_write_read(spark, monkeypatch):
    rows = [(5, "b b"), (None, "null id"), (1, None), (3, "w " * 5000), (3, "again"), (9, ""), (2, "é\n\nx")] + [(100 + i, f"t{i} " * i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    path = shared_dir(spark)
    T.write_tokens(df, path, P.path("byte_bpe_50k.json"), text="body")
    got = T.with_starts(T.read_tokens(spark, path), path).orderBy("start").collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 2])
    at = 0
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    for r in got:
        ids = list(array("I", r.ids))
        assert ids in want[r.doc_id] and r.start == at and r.n_tokens == len(ids)
        at += len(ids)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = shared_dir(spark)
    T.write_tokens(df, path, P.path("byte_bpe_50k.json"))
    assert T.with_starts(T.read_tokens(spark, path), path).count() == 0
    assert K.pack(K.cut(df, P.path("word_bpe_49k.json"), 2048), 2048).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_pack(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i, f"word{i} " * (i % 97)) for i in range(800)] + [(1000, None), (1001, "x " * 5000), (1002, ""), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = K.pack(K.cut(df, P.path("word_bpe_49k.json"), 64, with_ids=True), 64).collect()
    used = check_packing(got, 64)
    assert used <= -(-sum(r.length for r in got) // 64) * 1.02 + 1
    want = []
    for d, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            p = ids[k : k + 64]
            want.append((d, k // 64, k, len(p), zlib.crc32(array("I", p).tobytes())))
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)


@pytest.mark.parametrize("lengths", [[1], [64], [33] * 50, [32] * 51, [40, 24] * 30 + [64] * 1000, [21, 22, 21] * 100])
def test_solver(lengths):
    sizes, counts = np.unique(lengths, return_counts=True)
    found = K.rounded(sizes, counts, 64)
    used = np.zeros(len(sizes), int)
    for p, k in found:
        assert sum(sizes[j] * m for j, m in p) <= 64
        for j, m in p:
            used[j] += m * k
    assert (used == counts).all()
    alone = sum(n > 32 for n in lengths)
    assert sum(k for _, k in found) <= max(alone, -(-sum(lengths) // 64)) + 1


def test_pack_refuses(spark):
    for n in (0, 65, None):
        with pytest.raises(Exception, match="length"):
            K.pack(spark.createDataFrame([(n,)], "length long"), 64).count()


@pytest.mark.parametrize("many", [700, 1500])
def test_solver_leaves_little(monkeypatch, many):
    sizes = np.array([many, 1999])
    counts = np.array([1_000_000, 1000])
    left = []
    fit = K.best_fit
    monkeypatch.setattr(K, "best_fit", lambda lengths, rest, *more: left.append(int(rest.sum())) or fit(lengths, np.minimum(rest, 100), *more))
    K.rounded(sizes, counts, 2048)
    assert left[0] <= 2 * K.ROUNDS * len(sizes) * (2048 // many)
    monkeypatch.setattr(K, "best_fit", fit)
    if left[0] < 1000:
        found = K.rounded(sizes, counts * 10**6, 2048)  # no step per piece
        assert sum(k for _, k in found) <= 10**12 // (2048 // many) + 10**9 + 1


def test_best_fit_by_counts():
    rng = random.Random(6)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 65), rng.randrange(1, 8))))
        counts = np.array([rng.randrange(0, 30) for _ in sizes])
        found = K.best_fit(sizes, counts, 64)
        used = np.zeros(len(sizes), int)
        for p, k in found:
            for j, m in p:
                used[j] += m * k
        assert (used == counts).all()
        rooms = []
        for size, n in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
            for _ in range(n):
                fits = [r for r in rooms if r >= size]
                if fits:
                    rooms.remove(min(fits))
                rooms.append((min(fits) if fits else 64) - size)
        assert sorted(rooms) == sorted(64 - sum(int(sizes[j]) * m for j, m in p) for p, k in found for _ in range(k))


@pytest.mark.parametrize("seed", range(10))
def test_solver_never_behind_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(40, 200))
    least, most = sorted(rng.integers(1, capacity + 1, 2))
    sizes, counts = np.unique(rng.integers(least, most + 1, int(rng.integers(50, 5000))), return_counts=True)
    found = K.rounded(sizes, counts, capacity)
    used = np.zeros(len(sizes), np.int64)
    for p, k in found:
        assert sum(int(sizes[j]) * m for j, m in p) <= capacity
        for j, m in p:
            used[j] += k * m
    assert used.tolist() == counts.tolist()
    assert sum(k for _, k in found) <= sum(k for _, k in K.best_fit(sizes, counts.copy(), capacity))


def test_encoder_starts_no_threads():
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = """
import os, public_tokenizers
from gridweave.llm.token_files import library_encoder
encoder = library_encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
before = len(os.listdir("/proc/self/task"))
encoder.encode_many([f"word{i}" for i in range(5000)])
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], env=env, capture_output=True, text=True, check=True)
    assert got.stdout.split() == ["0"]


def test_words_encoded_together_have_their_own_ids():
    import random

    import public_tokenizers

    from gridweave.llm.token_files import library_encoder

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeéßñÀüxyzįİ") for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    for vocabulary, blank_matters in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = library_encoder(public_tokenizers.path(vocabulary), blank_matters)
        chunks = list({rng.choice(["", " "]) + w if blank_matters else w.lower() for w in words})
        assert encoder.encode_words is not encoder.encode_many
        assert encoder.encode_words(chunks) == encoder.encode_many(chunks)
        assert encoder.encode_words([]) == []


def test_blanks_are_those_of_python():
    from gridweave.llm.memo import _BLANK

    signs = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    assert pc.match_substring_regex(pa.array(signs), _BLANK).to_pylist() == [c.isspace() for c in signs]


def test_words_are_remembered():
    """What was encoded once isn't encoded again, be it 250,000 words, and the ids stay the same."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(250_000)]
    texts = ["x " + " ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    vocabulary = P.path("byte_bpe_50k.json")
    T._LOADED.clear()
    try:
        large = T.library_encoder(vocabulary, True, T.REMEMBERED)
        first = large.encode(texts, 2)
        encoded, large.encode_words = [], lambda chunks, old=large.encode_words: encoded.extend(chunks) or old(chunks)
        assert large.encode(texts, 2) == first and not encoded
    finally:
        T._LOADED.clear()


def test_no_search_for_cycles_while_encoding():
    import gc

    from gridweave.llm.common import uncollected

    def run(batches):
        for batch in batches:
            assert not gc.isenabled()
            yield batch + 1

    assert gc.isenabled() and [*uncollected(run)(iter([1, 2]))] == [2, 3] and gc.isenabled()
    broken = uncollected(run)(iter([1, "x"]))
    with pytest.raises(TypeError):
        [*broken]
    assert gc.isenabled()
