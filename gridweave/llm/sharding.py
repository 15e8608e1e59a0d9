"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` places on a ring of 2**32, each key one; a key prefers the shard whose place is next clockwise.
The keys between two places are an arc, taken in ring order. Shards have a capacity in rows: the mean, rounded up for as
many shards as the remainder says, times 1 + ``slack``. Arcs are filled one after another in the ring's order: an arc's
keys go to its own shard as long as that has room, the rest continue clockwise to the next shard that has.

What an arc's keys do hangs only on how many they are, so the plan is made from the counts of the arcs: as many numbers as
there are virtual nodes, whatever the data. It has a run of ranks for each arc and each shard that filled up within one. Each
key then needs its rank within its arc, which comes from running counts over ranges of ring places, so that a key which a
third of all rows have is spread over many tasks, ranges and shards. A row's slot is its rank less the start of its run plus what
the shard held before. Texts are never shuffled for this: sizes and checksums are.

With no slack the counts of all shards differ by at most one. A further shard takes its arcs from all others; other rows move only
where a capacity shrank, or room was left.

Edge cases: a null key counts as the empty text; a null text has 0 bytes and the crc32 of no bytes; keys that are equal,
and repeated rows, are ordered by size and checksum, then as they are read (rows alike in all of these are interchangeable);
very long texts count whole; an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.llm.common import discard, materialise, unused_name

VNODES = 128
#: Parts that the rows of one ring place may be spread over.
SPREAD = 256


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """place, shard of all virtual nodes in ring order, hashed as keys are."""
    names = spark.range(shards * vnodes).select((F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("v"))
    found = names.select(place(F.concat(F.lit("shard "), F.col("shard"), F.lit(" node "), F.col("v"))).alias("at"), "shard").groupBy("at").agg(F.min("shard").alias("shard"))
    return sorted((r["at"], r["shard"]) for r in found.collect())  # shards * vnodes rows


def place(key: Column) -> Column:
    """Where a key is on the ring: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold; without slack as many in all as there are."""
    return [int((rows // shards + (s < rows % shards)) * (1 + slack)) for s in range(shards)]


def plan_runs(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """arc, first rank, shard, first slot: runs of ranks by the counts of the arcs in ring order."""
    used, runs = [0] * len(room), []
    for arc, n in enumerate(counts):
        at, clockwise = 0, chain(owners[arc:], owners[:arc], range(len(room)))  # at last those that lost all places to others
        while at < n:
            shard = next(clockwise)
            take = min(n - at, room[shard] - used[shard])
            if take > 0:
                runs.append((arc, at, shard, used[shard]))
                used[shard] += take
                at += take
    return runs


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key with size (UTF-8 bytes and one more) and text_crc32 of each row."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))


def assign(rows: DataFrame, shards: int, vnodes: int = VNODES, slack: float = 0.0, key: str = "doc_id") -> DataFrame:
    """The key, size and text_crc32 of ``rows`` with shard and slot (from 0, without gaps in each shard)."""
    spark = rows.sparkSession
    nodes = ring(spark, shards, vnodes)
    starts, owners = np.array([at for at, _ in nodes]), [s for _, s in nodes]

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, at.to_numpy()) % len(starts))

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    d = rows.select(key, "size", "text_crc32", name.alias("name_"), place(name).alias("at_"))
    d = materialise(d.withColumn("arc_", arc_of("at_")).withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")))  # written, so that each read gives the same
    by = ["at_", "name_", "size", "text_crc32", "salt_"]
    parts = materialise(d.repartitionByRange("arc_", *by).withColumn("part_", F.spark_partition_id()))
    counts, before = [0] * len(nodes), []
    for arc, part, n in sorted((r["arc_"], r["part_"], r["n"]) for r in parts.groupBy("arc_", "part_").agg(F.count("*").alias("n")).collect()):  # fewer rows than arcs and parts together
        before.append((arc, part, counts[arc]))
        counts[arc] += n
    discard(d)
    runs = plan_runs(counts, owners, capacities(sum(counts), shards, slack))
    first = np.array([(arc << 44) + rank for arc, rank, _, _ in runs] or [0])
    ranks, to, slots = (np.array([r[k] for r in runs] or [0]) for k in (1, 2, 3))

    @F.pandas_udf("shard int, slot bigint")
    def put(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(first, (arc.to_numpy().astype(np.int64) << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"shard": to[k].astype(np.int32), "slot": slots[k] + rank.to_numpy() - ranks[k]})

    earlier = F.broadcast(spark.createDataFrame(before, "arc_ int, part_ int, before_ bigint"))
    local = F.row_number().over(Window.partitionBy("arc_", "part_").orderBy(*by)) - 1
    ranked = parts.withColumn("local_", local).join(earlier, ["arc_", "part_"])
    return ranked.withColumn("put_", put("arc_", F.col("local_") + F.col("before_"))).select(key, "size", "text_crc32", "put_.shard", "put_.slot")


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = VNODES, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, size, text_crc32, shard, slot."""
    return assign(measured(docs, key, text), shards, vnodes, slack, key)


def write_shards(docs: DataFrame, path: str, shards: int = 16, vnodes: int = VNODES, slack: float = 0.0, key: str = "doc_id", files: int = 1) -> None:
    """All columns of ``docs`` and slot as Parquet below ``path``/shard=k, in the order of slots, each shard in about ``files`` files.

    Rows with equal keys raise ValueError, as their places couldn't be told apart; so do columns named shard or slot.
    """
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist: {sorted(clash)}")
    put = materialise(shard_documents(docs, shards, vnodes, slack, key).select(key, "shard", "slot"))
    if not put.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("keys are repeated")
    share = F.greatest(F.lit(1), F.ceil(F.lit(put.count()) / F.lit(shards * files))).cast("bigint")
    file = unused_name(docs, "file")
    told = docs.join(put, docs[key].eqNullSafe(put[key])).drop(put[key]).withColumn(file, F.floor(F.col("slot") / share))
    told.repartition("shard", file).sortWithinPartitions("shard", "slot").drop(file).write.partitionBy("shard").parquet(path)
    discard(put)
