"""Line-first cleaning with built-in functions only.

Each line with a word is judged first; a line fails if it

- repeats an earlier line of its text (boilerplate),
- has ``NAV_BARS`` or more bars or arrows between short items, or at most three words without closing punctuation (navigation),
- says one of ``PHRASES`` (boilerplate),
- has more than ``MAX_SYMBOLS`` percent symbols, shouts (``MIN_SHOUTS`` or more ``!!``), or breaks off in an ellipsis (punctuation).

Failing lines are removed; a text that keeps less than ``MIN_KEPT`` percent of its word characters is
rejected. A text that fails the base counts (under ``MIN_WORDS`` words, or above ``MAX_REPEAT`` percent of
them in five-word windows that stand twice) is rejected before that.

Windows are compared by 64-bit hashes within one text, and only texts where some hash stands twice are
looked at place by place. There is no shuffle: all is one projection over the scan.

Edge cases: null text has no words or lines, fails the base counts and cleans to an empty text; lines
without a word neither fail nor count; a text without a line break is one line; texts of any length are read whole; repeated
rows each get their answer, and an empty table gives an empty one; columns that have an added name raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import BLANKS

MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
NAV_BARS, MAX_SYMBOLS, MIN_SHOUTS, MIN_KEPT = 4, 8, 3, 50
#: Phrases of page furniture, in lower case.
PHRASES = ("javascript is disabled", "enable javascript", "accept cookies", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "lorem ipsum", "sign up for our newsletter", "skip to content")

#: A line of at most three words that ends without closing punctuation, and one that breaks off.
SHORT_LINE = r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){0,2}[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?:;)»”…\x22\x27][\x20\x09-\x0D]*\z"
BROKEN_LINE = r"(\.\.\.|…)[\x20\x09-\x0D]*\z"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS[1:], " " * 5), " "), lambda w: w != "")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))


def _letters(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, BLANKS, ""))


def _repeated(w: Column) -> Column:
    """A hash of each five-word window of the array ``w``."""
    n = F.size(w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row, not again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Number of words in windows whose hash stands twice or more."""
    def places(ranked: Column) -> Column:
        same = lambda x, k: (F.get(ranked, k - 1)["h"] == x["h"]) | F.coalesce(F.get(ranked, k + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ranked, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

    found = _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("end"))
    step = lambda acc, p: F.struct((acc["total"] + WINDOW - F.greatest(F.lit(0), acc["end"] - p)).cast("bigint").alias("total"), (p + WINDOW).alias("end"))
    return F.aggregate(found, zero, step, lambda acc: acc["total"])


def line_fails(line: Column) -> Column:
    """The rules for one line but that for repeated ones."""
    low = F.lower(line)
    bars = F.length(line) - F.length(F.translate(line, "|»›", ""))
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | F.contains(low, F.lit(p))
    return (bars >= NAV_BARS) | (_symbols(line) * 100 > MAX_SYMBOLS * _letters(line)) | (shouts >= MIN_SHOUTS) | phrase | F.rlike(line, F.lit(SHORT_LINE)) | F.rlike(line, F.lit(BROKEN_LINE))


def _once(lines: Column) -> Column:
    """The lines without later copies: sorted by line, marked, and sorted back by place."""
    ranked = F.sort_array(F.transform(lines, lambda x, k: F.struct(x.alias("line"), k.alias("k"))))
    marked = _let(ranked, lambda r: F.filter(r, lambda x, i: F.coalesce(F.get(r, i - 1)["line"] != x["line"], F.lit(True))))
    return F.transform(F.sort_array(F.transform(marked, lambda x: F.struct(x["k"].alias("k"), x["line"].alias("line")))), lambda x: x["line"])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed and clean_text."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "clean_text"]
    clash = {*added, "body_", "words_", "lines_", "good_", "hashes_"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    long = lambda c: c.cast("bigint")
    df = docs.withColumn("body_", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("words_", words(F.col("body_")))
    df = df.withColumn("hashes_", _let(F.col("words_"), _repeated)).withColumn("n_words", long(F.size("words_")))
    df = df.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("hashes_")) == F.size("hashes_"), F.lit(0).cast("bigint")).otherwise(_let(F.col("hashes_"), _covered)))
    df = df.withColumn("lines_", F.filter(F.split("body_", "\n"), lambda x: _letters(x) > 0))
    once = F.when(F.size(F.array_distinct("lines_")) == F.size("lines_"), F.col("lines_")).otherwise(_once(F.col("lines_")))
    df = df.withColumn("good_", F.filter(once, lambda x: ~line_fails(x)))
    df = df.withColumn("word_chars", long(_letters(F.col("body_")))).withColumn("n_symbols", long(_symbols(F.col("body_"))))
    df = df.withColumn("n_lines", long(F.size("lines_"))).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines_")))
    df = df.withColumn("n_lines_removed", F.col("n_lines") - F.size("good_")).withColumn("clean_text", F.array_join("good_", "\n"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (_letters(F.col("clean_text")) * 100 >= F.col("word_chars") * MIN_KEPT))
    return df.select(*docs.columns, *added)


_phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in PHRASES)
#: The same counts and rules by window functions over words and lines.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws, body FROM d),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + {WINDOW - 1}]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, generate_series(0, {WINDOW - 1}) t(k) WHERE n > 1 GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM d),
l1 AS (SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l0),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l1 WHERE chars > 0),
f AS (SELECT *, nth > 1
        OR length(line) - length(translate(line, '|»›', '')) >= {NAV_BARS}
        OR (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 100 > {MAX_SYMBOLS} * chars
        OR (length(line) - length(replace(line, '!!', ''))) / 2 >= {MIN_SHOUTS}
        OR regexp_matches(line, '{SHORT_LINE}') OR regexp_matches(line, '{BROKEN_LINE}') OR {_phrases} AS fails FROM l),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_lines_removed, coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS left_chars FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(left_chars, 0) AS left_chars
        FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_chars * 100 >= word_chars * {MIN_KEPT} AS kept, n_lines, n_lines_removed
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM b)
"""
