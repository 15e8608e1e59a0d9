"""Grouping spelling variants by asymmetric q-chunks.

Two words are near at an edit distance of exactly one. Each word stands once on either side of a join: on the one it
contributes two disjoint chunks, its halves, on the other its positional grams of the sizes that such halves have. One
edit leaves a chunk of the longer word as it is: the first half then stands in the other word at the same place, the
second one is shifted by the difference of lengths, at most one. So of all positional grams those at such places can
meet a chunk, and only they are made: four for each word.

A chunk that very many words share (``LIMIT`` possible pairs or more) isn't joined. It is known to match, so the edit
lies in the other half, and that is halved again by the same rule on both sides: the key becomes the known part with a
quarter of the word, and so on. At a rest of one code point the words of a key are near to each other, so no more rows are
joined than there are links. No key is dropped, and the work doesn't grow with the square of a key's words.

Every candidate is verified by an edit distance over code points.

Edge cases of ``count_words``: null and empty texts and texts without letters have no words; very long texts are read
whole; a null id counts as the empty text; repeated rows count as often as they stand; an empty table gives no rows; other
columns of the table, whatever their names, aren't read. Of ``group_variants``: null words are dropped and the counts of
repeated ones added up; ties go to the word that is smallest in code-point order; words without a near one have a null form
and are their own root.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import discard, materialise, tidy

#: Pairs that a key may give before it is split.
LIMIT = 4096
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 100_000
#: In Latin-1: letters stay, A-Z as a-z, everything else is a blank.
_LETTERS = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 0xC0 else 32 for k in range(256))


def count_words(docs: DataFrame, least: int = 5, modulus: int = 97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all runs of letters, A to Z lower-cased, of at least ``least`` code points.

    Where ``modulus`` divides the crc32 of ``<doc_id>:<run>`` the code point at crc32 % length is deleted first (a
    planted slip); 0 plants none. The crc hangs on document and run alone, so it is taken once for each distinct run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words, n = [w.decode("latin-1") for w in held], list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                if not body.is_valid:
                    continue
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                runs = Counter(body.as_py().encode("latin-1", "replace").translate(_LETTERS).split())
                for w, n in runs.items():
                    if len(w) < least:
                        continue
                    if modulus:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % modulus == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                    held[w] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    counts = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(tidy(run), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _sides(words: DataFrame) -> DataFrame:
    """Each word with the whole of itself as the part that holds the edit: for its own length as the chunk side, for its own and the next one as the gram side."""
    size = F.char_length("word")
    roles = F.array(*(F.struct(F.lit(chunk).alias("chunk"), length.alias("len")) for chunk, length in ((True, size), (False, size), (False, size + 1))))
    return words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.chunk", "r.len", F.lit(0).alias("lo"), F.col("r.len").alias("hi"))


def _halved(rows: DataFrame) -> DataFrame:
    """Either half of the part ``lo`` to ``hi`` (places in the chunk word, of ``len`` code points) as known, with the key of what is known."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    rests = F.array(*(F.struct(a.alias("lo"), b.alias("hi")) for a, b in ((mid, F.col("hi")), (F.col("lo"), mid))))
    d = rows.select("word", "n", "chunk", "len", F.explode(rests).alias("r")).select("word", "n", "chunk", "len", "r.lo", "r.hi")
    behind = F.col("len") - F.col("hi")
    size = F.char_length("word")
    d = d.where((F.col("hi") > F.col("lo")) & (size >= F.col("lo") + behind))
    key = F.xxhash64("len", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - behind + 1, behind))
    return d.withColumn("key", key)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n for both directions of each near pair of ``words`` (word, n; no word twice)."""
    todo, found, used = _sides(words), None, []
    while True:
        rows = materialise(_halved(todo))
        count = lambda side: F.count_if(F.col("chunk") == side)
        keys = materialise(rows.groupBy("key").agg(count(True).alias("chunks"), count(False).alias("grams"), F.max(F.col("hi") - F.col("lo")).alias("rest")).where("chunks > 0 and grams > 0").select("key", ((F.col("chunks") * F.col("grams") >= limit) & (F.col("rest") > 1)).alias("hot")))
        met = rows.join(keys.where("not hot").select("key"), "key")
        a = met.where("chunk").select("key", "len", F.col("word").alias("a"), F.col("n").alias("an"))
        b = met.where("not chunk").select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
        # words of one length meet in both roles
        pairs = a.join(b, "key").where((F.char_length("b") < F.col("len")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn")
        pairs = materialise(pairs)
        found = pairs if found is None else found.unionByName(pairs)
        used.append(pairs)
        hot = keys.where("hot").select("key")
        if hot.isEmpty():
            discard(rows, keys)
            break
        todo = rows.join(hot, "key").drop("key")
        used += [rows, keys]
    both = found.distinct()  # an edit between the halves leaves both
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}n").alias("near_n")) for x, y in ("ab", "ba"))))
    out = materialise(both.select(ends.alias("e")).select("e.*"))
    discard(*used)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form from each word that has one. Counts at least double from form to form, so few rounds of doubling do."""
    to = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        discard(to)
        to = new.drop("moved")
        if not moved:
            return to


def group_variants(words: DataFrame, ratio: int = 2, limit: int = LIMIT) -> DataFrame:
    """For each of ``words`` (word, n): form, root, n, n_near, form_n.

    The form is the near word of largest n, if that is at least ``ratio`` times the word's own.
    """
    words = materialise(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(words, limit)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    good: Column = -F.col("best.m") >= ratio * F.col("n")
    known = materialise(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    roots = _roots(known.where("form is not null"))
    out = materialise(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    discard(words, near, known, roots)
    return out


#: The crc32 is made bit by bit, as DuckDB has no function for it. Near pairs come another way than in the method: two words share what is left after one deletion at the same place, or one is what is left of the other.
_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
ORACLE = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE length(w) >= 5 GROUP BY 1, 2),
b AS (SELECT doc_id, w, k, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..')] AS bytes FROM runs),
q AS (SELECT i, 0 AS bit, i AS c FROM range(256) r(i) UNION ALL SELECT i, bit + 1, {_STEP.format(c='c')} FROM q WHERE bit < 8),
t AS (SELECT i, c AS v FROM q WHERE bit = 8),
s AS (SELECT doc_id, w, k, bytes, 1 AS p, 4294967295 AS c FROM b UNION ALL SELECT doc_id, w, k, bytes, p + 1, xor(c >> 8, t.v) FROM s JOIN t ON t.i = xor(c & 255, bytes[p]) WHERE p <= len(bytes)),
h AS (SELECT w, k, xor(c, 4294967295) AS h FROM s WHERE p = len(bytes) + 1),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, k FROM h),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
pairs AS (SELECT x.word, y.word AS near, y.n AS m FROM d x JOIN d y ON y.rest = x.rest AND y.p = x.p AND y.word != x.word UNION SELECT x.word, y.word, y.n FROM d x JOIN words y ON y.word = x.rest UNION SELECT y.word, x.word, x.n FROM d x JOIN words y ON y.word = x.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(near) FILTER (WHERE m = most) AS near FROM (SELECT *, max(m) OVER (PARTITION BY word) AS most FROM pairs) GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z USING (word)
"""
