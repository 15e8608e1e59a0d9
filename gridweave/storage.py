"""Tables between the stages of an operator, below the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting there is none to be had on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"{os.getcwd()}/spark-checkpoints"  # one machine: any folder is shared
    return f"{top.rstrip('/')}/gridweave-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/gridweave-" in path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def running(df: DataFrame, by: list[str], order: list[str], value: str, name: str, total: str | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group ``by`` up to each row in ``order``, itself and ties included; and ``total``: that of the whole group.

    Rows are dealt by ranges of group and order, so a large group is spread over many tasks; what goes before a
    part comes from one row for each part and group. Rows that tie are in one part.
    """
    parts = materialise(df.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id()))
    sums = parts.groupBy(*by, "part_").agg(F.sum(value).alias("sum_"))
    whole = [F.sum("sum_").over(Window.partitionBy(*by)).alias(total)] if total else []
    before = sums.select(*by, "part_", (F.sum("sum_").over(Window.partitionBy(*by).orderBy("part_")) - F.col("sum_")).alias("before_"), *whole)
    local = F.sum(value).over(Window.partitionBy(*by, "part_").orderBy(*order))
    return parts.withColumn("local_", local).join(before, [*by, "part_"]).withColumn(name, F.col("local_") + F.col("before_")).drop("part_", "local_", "before_")
