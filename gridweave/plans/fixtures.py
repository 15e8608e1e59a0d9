"""Rasters, stacks, points and series made from the star-schema tables, in Spark and in DuckDB SQL.

Array access differs (0-based against 1-based), so those have two texts; all others share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PV = "WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j, embedding FROM embeddings) SELECT CAST(label AS {s}) AS image_id, CAST(j AS INT) AS j, i, 0 AS c, CAST(embedding[{k}] AS DOUBLE) AS v FROM (SELECT label, j, embedding, {e} AS i FROM e) t"
_PS = "SELECT vec_id AS image_id, CAST(label AS INT) AS j, i, CAST(embedding[{k}] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, {e} AS i FROM embeddings) t"
_KP = "SELECT vec_id AS id, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS side, 100 * CAST(embedding[{a}] AS DOUBLE) AS x, 100 * CAST(embedding[{b}] AS DOUBLE) AS y, embedding AS descr FROM embeddings"
_SPARK = {"s": "STRING", "k": "i", "e": "explode(sequence(0, 63))", "a": 0, "b": 1}
_DUCK = {"s": "VARCHAR", "k": "i + 1", "e": "CAST(unnest(generate_series(0, 63)) AS INT)", "a": 1, "b": 2}
_SAME = {
    "PE": "SELECT event_type AS image_id, CAST(extract(day FROM ts) AS INT) - 1 AS j, CAST(extract(hour FROM ts) AS INT) AS i, 0 AS c, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "PL": "SELECT l_returnflag AS image_id, CAST(l_partkey % 32 AS INT) AS j, CAST(l_suppkey % 16 AS INT) AS i, 0 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3",
    "PU": "SELECT event_type AS image_id, CAST(extract(day FROM ts) AS INT) - 1 AS j, CAST(extract(hour FROM ts) AS INT) AS i, 0 AS c, CAST(least(250, floor(max(value))) AS DOUBLE) AS v FROM events GROUP BY 1, 2, 3",
    "PTS": "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part",
    "SEG": "SELECT * FROM (SELECT event_id AS id, lag(CAST(extract(hour FROM ts) AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x1, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y1, CAST(extract(hour FROM ts) AS DOUBLE) AS x2, value AS y2 FROM events) t WHERE x1 IS NOT NULL",
    "TS": "SELECT event_type, CAST((extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS INT) AS t, count(*) AS v FROM events GROUP BY 1, 2",
    "LI": "SELECT l_orderkey AS id, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS z FROM lineitem",
}
SQL = {k: (v, v) for k, v in _SAME.items()} | {k: (t.format(**_SPARK), t.format(**_DUCK)) for k, t in (("PV", _PV), ("PS", _PS), ("KP", _KP))}
_TABLES = ("embeddings", "events", "lineitem", "part")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame. Tables are read by name through temporary views."""
    text = SQL[name][0]
    for t in _TABLES:
        if f"FROM {t}" in text:
            view = f"gridweave_{t}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view)
            text = text.replace(f"FROM {t}", f"FROM {view}")
    return spark.sql(text)


def duck(name: str) -> str:
    return SQL[name][1]
