import hashlib
import re
import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridweave.llm import licences, quality_rules

TEXTS = ["Main page\nsame\nsame line here again\nsame\nAnd so it went on for a long while, as told.\nsame line here again\nIt breaks off there...\r\nIt breaks off …\n\"Well?\"\none two\rthree", None, "", " \n\t", "a b c d e f g h i j k l", "x y z w v " * 3, "one " * 30, "Home | About | News | Shop | Login\n" + "good words here and there in a fine long line. " * 3, "same line of several words\nsame line of several words\nother", "a\x0bb\x0cc\rd　e\x1cf", "##% $$ &&& *** <> | |", "BUY!! NOW!! GO!! YES!!\nplain words follow on this line of text today, ok", "Accept cookies to go on\n" + " ".join(f"w{i}" for i in range(50)), "w " * 3 + " ".join(f"q{i}" for i in range(4000))]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS * 2)], "doc_id int, text string, Lines int")
    for r in quality_rules.clean(df).collect():
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
        if r.text and r.text.startswith("Home"):
            assert r.n_lines_removed == 1 and not r.clean_text.startswith("Home")
    assert quality_rules.clean(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op4_quality_rules", "op8_licences"])
def test_sql(spark, tmp_path, name):
    from gridweave.llm.queries import ORACLE_SQL, QUERIES

    known = [f"Copyright 2020 A. Person\n\n{t.upper()}" for t in licences.KNOWN.values()]
    df = spark.createDataFrame(list(enumerate(TEXTS + known)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES[name](spark, str(tmp_path))
    want = c.sql(ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r[k] for k in order) for r in got.collect()) == sorted(tuple(r) for r in want.select(*order).fetchall())


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    texts = [mit, "The MIT License (MIT)\n\nCopyright (c) 2001 X\n\n" + mit.replace("\n", "  \n ").replace("sublicense", "sub-licence"), mit + " and more", None, "", "Copyright X"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, known_digest string")
    assert [r.licence for r in licences.scan(df).orderBy("doc_id").collect()] == ["MIT", "MIT", None, None, None, None]


@pytest.mark.parametrize("before", ["", "Copyright (c) 2020 Jane Doe\n", "The X License\n\nCopyright © 2019-2021 José Öst & Co. <a@b.org>, All rights reserved.\n\n", "Copyright 2018 A. Holder of a rather long name, of the Institute of Long Names\nCopyright 2019, 2021 Another One, of the University of a Town\n(c) 2022 B.\n"])
def test_licences_rewrapped(spark, before):
    """Every known text at four widths and on one line; a statement before those that may have one doesn't matter."""
    rows = []
    for name, text in licences.KNOWN.items():
        if before and name not in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "MIT-0", "Zlib"):
            continue
        own = before + text
        rows += [(name, textwrap.fill(" ".join(own.split()), w, break_long_words=False, break_on_hyphens=False)) for w in (40, 60, 72, 100)] + [(name, " ".join(own.split())), (name, own.upper()), (name, own.replace("license", "licence"))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id int, wanted string, text string")
    wrong = [(r.wanted, r.licence, r.text[:80]) for r in licences.scan(df).collect() if r.licence != r.wanted]
    assert rows and not wrong, wrong[:5]


def test_licences_others(spark):
    """Texts that aren't a licence keep their words, statements included."""
    one = " ".join(licences.KNOWN["MIT"].split())
    texts = ["Copyright (c) 2020 X", "Copyright (c) 2020 Jane Doe. It was a bright cold day in April, and the clocks were striking thirteen.", one[:-40], licences.KNOWN["GPL-3"] + " and so on", "copyright 2020 a " * 3000, "Copyright (c) 2020 " + "y" * 90 + " " + one]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = licences.scan(df.union(df)).collect()
    assert all(r.licence is None and r.licence_digest != hashlib.sha256(b"").hexdigest() for r in got) and len(got) == 2 * len(texts)
    assert licences.scan(df.limit(0)).count() == 0
    assert licences.scan(df.select("doc_id", F.repeat("text", 300).alias("text"))).where("licence is not null").count() == 0
    with pytest.raises(ValueError):
        licences.scan(df.withColumn("Licence", F.lit(1)))
