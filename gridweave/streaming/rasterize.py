"""Points that arrive in files update the running statistics of the cells they fall in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridweave.operators.points import rasterize


def rasterize_stream(points: DataFrame, path: str, checkpoint: str, **grid) -> StreamingQuery:
    """Write each change of the grid's cells to ``path``; the state has one row per cell, whatever arrives.

    ``grid`` are the arguments of ``rasterize``. A batch replaces nothing: rows carry the batch's number, the
    last one of a cell holds.
    """
    from pyspark.sql import functions as F

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return rasterize(points, **grid).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest_cells(spark, path: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.read.parquet(path)
    return rows.groupBy("j", "i").agg(F.max_by(F.struct("mean", "lo", "hi", "n"), "batch").alias("x")).select("j", "i", "x.*")
