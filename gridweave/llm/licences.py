"""Finding documents that are a known licence, by digests of their canonical texts.

A text is put into canonical form by built-in functions: lower case, equivalent spellings made equal, everything but
letters and digits turned into single spaces, so that line breaks are gone before anything else is decided. Only then go
reservations of all rights, copyright statements that stand right before the first words of a licence (a word or sign for
it, years or a sign, and a holder of at most 80 signs) and the licence's own title at the start. The SHA-256 of the rest
is joined with the digests of the known licences, which are made by the same expression from the whole texts in
``licence_texts``, one file each, named by its SPDX identifier; there are as many rows as files, so they are broadcast.

Edge cases: null and empty texts and those with nothing left have the digest of the empty string and match nothing; a
licence inside a longer text doesn't match, since whole texts are compared; a text that only begins with a statement keeps
it; repeated rows each get their answer; texts of any length are read whole; an empty table gives an empty one; columns that
have an added name raise ValueError. More than ``STACKED`` statements of over 80 signs each before a licence, or a holder
with neither year nor sign, stay, and such a copy doesn't match.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import unused_name

#: Spellings that count as the same, after lower-casing.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("whilst", "while"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("©", "(c)"), ("https:", "http:"))
#: The same for words in a row, once these have one space between them.
PHRASES = (("copyright owner", "copyright holder"),)
#: In canonical text: years of a statement, and first words of licences that a statement may stand before.
YEARS = "(?:(?:19|20)[0-9][0-9]|year|yyyy|present)"
OPENINGS = "permission is hereby|permission to use|redistribution and use|licensed under|this software is provided"
STATEMENT = rf"(^| )(?:copyright c (?:{YEARS} )*|copyright (?:{YEARS} )+|c (?:{YEARS} )+)[^\x00]{{0,80}}?({OPENINGS})"
STACKED = 3
TITLE = r"^(?:the )?[a-z0-9 ]{1,30} license (?:(?:mit|isc|bsd|0bsd) )?"
KNOWN = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.trim(F.regexp_replace(out, r"[\x00-\x2f\x3a-\x60\x7b-\x7f“”‘’–—\u00a0]+", " "))
    for a, b in PHRASES:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, "all rights reserved ?", "")
    for _ in range(STACKED):
        out = F.regexp_replace(out, STATEMENT, "$1$2")
    return F.trim(F.regexp_replace(F.trim(out), TITLE, ""))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, text: str = "text") -> DataFrame:
    """Add licence (null: none) and licence_digest to each row of ``docs``."""
    clash = {"licence", "licence_digest"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    key = unused_name(docs, "known_digest")
    table = docs.sparkSession.createDataFrame(list(known.items()), "licence string, body string")
    table = table.select(digest(F.col("body")).alias(key), "licence").groupBy(key).agg(F.min("licence").alias("licence"))
    signed = docs.withColumn("licence_digest", digest(F.col(text)))
    return signed.join(F.broadcast(table), F.col("licence_digest") == F.col(key), "left").drop(key)


def _sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"trim(regexp_replace({out}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f“”‘’–—\\x{{a0}}]+', ' ', 'g'))"
    for a, b in PHRASES:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, 'all rights reserved ?', '', 'g')"
    for _ in range(STACKED):
        out = f"regexp_replace({out}, '{STATEMENT}', '\\1\\2', 'g')"
    return f"sha256(trim(regexp_replace(trim({out}), '{TITLE}', '')))"


_values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
ORACLE = f"""
WITH k AS (SELECT {_sql('body')} AS known, min(licence) AS licence FROM (VALUES {_values}) t(licence, body) GROUP BY 1)
SELECT doc_id, licence_digest, licence FROM (SELECT doc_id, {_sql('text')} AS licence_digest FROM documents) d LEFT JOIN k ON k.known = d.licence_digest
"""
