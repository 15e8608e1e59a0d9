"""Sources and sinks of rasters: text matrices and a partitioned store."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.pixels import tileize, untile


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files that Spark can decode, as samples: image_id is the file's name; channels in the file's order, red before green before blue."""
    def samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, w, h, n, data in zip(*(frame[c] for c in ("name", "width", "height", "n", "data"))):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                x = np.concatenate([x[:, :, 2::-1], x[:, :, 3:]], 2) if n >= 3 else x  # Spark has blue first
                j, i, c = np.indices(x.shape)
                yield pd.DataFrame({"image_id": name, "j": j.ravel(), "i": i.ravel(), "c": c.ravel(), "v": x.ravel().astype(float)})

    image = spark.read.format("image").option("dropInvalid", True).load(path)
    rows = image.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image.width", "image.height", F.col("image.nChannels").alias("n"), "image.data")
    return rows.mapInPandas(samples, "image_id string, j int, i int, c int, v double")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Width, height, channels and samples of each image of a store."""
    return read_raster(spark, path).groupBy("image_id").agg((F.max("i") + 1).alias("w"), (F.max("j") + 1).alias("h"), (F.max("c") + 1).alias("pd"), F.count("v").alias("n"))


def write_matrix_text(px: DataFrame, path: str, sep: str = " ") -> None:
    """Plain numbers, one line per raster row: a file below ``path``/image_id=.../c=... for each channel of each image; a missing sample is ``nan``.

    A channel is put together as one text, as it is read again as one file; rows that aren't there become lines of nan.
    """
    size = px.groupBy("image_id").agg(F.max("i").alias("last"), F.max("j").alias("rows"))
    cells = px.groupBy("image_id", "c", "j").agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("v").cast("string")))).alias("line"))  # as many as columns
    grid = px.select("image_id", "c").distinct().join(size, "image_id").withColumn("j", F.explode(F.sequence(F.lit(0), "rows")))
    body = F.concat_ws(sep, F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.try_element_at("line", i), F.lit("nan"))))
    lines = grid.join(cells, ["image_id", "c", "j"], "left").groupBy("image_id", "c").agg(F.sort_array(F.collect_list(F.struct("j", body.alias("s")))).alias("x"))
    lines.select("image_id", "c", F.array_join(F.col("x.s"), "\n").alias("value")).write.partitionBy("image_id", "c").text(path)


def read_matrix_text(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Files of plain numbers, one line per raster row, as samples: blanks, commas or ``sep`` between them.

    The image is named by the ``image_id=`` folder of the file, or else by the file; the channel is that of the ``c=`` folder, or else 0. Each
    file is one image and read as a whole by one task. What isn't a number is missing; empty lines don't count.
    """

    def samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, text in zip(frame["at"], frame["value"]):
                parts = dict(p.split("=", 1) for p in at.split("/") if "=" in p)
                name = unquote(parts.get("image_id", at.rsplit("/", 1)[-1]))
                lines = [line.replace(",", " ").split(sep) if sep is None else line.split(sep) for line in text.splitlines() if line.strip()]
                width = np.array([len(line) for line in lines], int)
                i = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                yield pd.DataFrame({"image_id": name, "j": np.repeat(np.arange(len(lines)), width), "i": i, "c": int(parts.get("c", 0)), "s": [s.strip() for line in lines for s in line]})

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("at"), "value")
    v = F.col("s").try_cast("double")
    return files.mapInPandas(samples, "image_id string, j int, i int, c int, s string").select("image_id", "j", "i", "c", F.when(~F.isnan(v), v).alias("v"))


def write_raster(px: DataFrame, path: str, side: int = 64) -> None:
    """Tiles partitioned by image and sorted by place, so a rectangle reads only its row groups."""
    tileize(px, side, side).withColumn("side", F.lit(side)).repartition("image_id", "tj").sortWithinPartitions("tj", "ti").write.partitionBy("image_id").mode("append").parquet(path)


def read_raster(spark: SparkSession, path: str, rect: tuple[int, int, int, int] | None = None, side: int | None = None) -> DataFrame:
    """``rect``: x0, y0, xf, yf, the far corner excluded; pushed down to the tiles, whose side the store tells."""
    tiles = spark.read.option("recursiveFileLookup", "false").parquet(path)
    side = side or (tiles.select("side").first() or [64])[0]
    if rect:
        x0, y0, xf, yf = rect
        tiles = tiles.where(f"ti between {x0 // side} and {(xf - 1) // side} and tj between {y0 // side} and {(yf - 1) // side}")
    px = untile(tiles, side, side)
    return px.where(f"i >= {x0} and i < {xf} and j >= {y0} and j < {yf}") if rect else px
