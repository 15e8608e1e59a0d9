"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.storage import discard, materialise, shared_dir

__all__ = ["BLANKS", "HELD", "discard", "give_back", "halved", "held_out", "materialise", "release", "shared_dir", "short_batches", "table", "tidy", "uncollected", "unused_name"]

#: What separates words: the ASCII blanks 0x20 and 0x09 to 0x0D, as bytes.split() has them.
BLANKS = " \t\n\x0b\x0c\r"
#: Spark's setting for the rows of a batch, and how many texts fit one.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Workers get ``BATCH_ROWS`` rows at a time from now on, unless the session has a number of its own.

    Batches are held whole: by the JVM, and twice by a worker while one follows the other. It splits batches, never rows.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_ROWS))


#: Memos that a Python worker holds from one task to the next.
HELD: list[dict] = []
Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """All freed memory back to the system, so that a worker that waits is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
    if trim:
        trim(0)


def release() -> None:
    """Forget what other operators hold in this worker, before one that needs the memory begins."""
    for memo in HELD:
        memo.clear()
    give_back()


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function of batches that starts without other operators' memos and leaves no freed memory with its worker."""

    def inner(batches: Batches) -> Batches:
        release()
        pool = pa.default_memory_pool()
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back as they are freed
        try:
            yield from run(batches)
        finally:
            pa.set_memory_pool(pool)
        give_back()

    return inner


def halved(run: Callable[[Batches], Batches], memos: Callable[[], list]) -> Callable[[Batches], Batches]:
    """The same for one that goes on with its memos: at the end the older halves of ``memos`` go."""

    def inner(batches: Batches) -> Batches:
        yield from run(batches)
        for memo in memos():
            memo.old = {}
        give_back()

    return inner


def uncollected(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function of batches during which Python doesn't look for cycles: a large memo has none, and each look walks through long lists of words."""

    def inner(batches: Batches) -> Batches:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return inner


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5: such rows never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
