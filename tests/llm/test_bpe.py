import random
from array import array

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gridweave.llm import bpe

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", "\n", " \n x", "a  b", "a\n b", "a\n \nb", "a　 b", "a\x1c b\x1d", "it's  we'll 12 345", "<|endoftext|>", "x  <|endoftext|> y", "ab" * 900, "z" * 5000, "\U0001f600‍ x́", "é è  ñ\t\tq", "\x00\x01", "中文字 テスト", "a\x85b \xa0 c"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "abcdeé ñ\n\t  '!?.,0123中　\x1c\x85́ABC<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_library(lib):
    b = bpe.RankBPE(PATH)
    texts = ODD + random_texts(3000)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [b.encode(t) for t in texts] == want
    packed = b.chunks.encode(texts)
    assert [list(array("I", x)) for x in packed] == want
    assert [list(array("I", x)) for x in b.chunks.encode(texts)] == want  # from the memo
    assert [b.decode(x) for x in want] == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_heap_equals_scan(monkeypatch):
    b = bpe.RankBPE(PATH)
    words = [t.encode() for t in ODD + random_texts(300) if t]
    scan = [b.merge(w) if len(w) <= bpe.LONG else None for w in words]
    monkeypatch.setattr(bpe, "LONG", 0)
    assert all(s is None or s == b.merge(w) for s, w in zip(scan, words))


def test_small_memo(lib):
    b = bpe.RankBPE(PATH)
    b.chunks.limit = 5
    texts = random_texts(50, 3)
    for _ in range(3):
        assert [list(array("I", x)) for x in b.chunks.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_decode_unknown():
    with pytest.raises(ValueError):
        bpe.RankBPE(PATH).decode([10**7])


def test_frames(spark, lib):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "hé <|endoftext|>", "x"), (None, "q" * 3000, "y")], "doc_id long, text string, Decoded_by string")
    rows = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in rows) == sorted(["", "", "hé <|endoftext|>", "q" * 3000])
    assert bpe.bpe_encode(df.limit(0), PATH).count() == 0
