"""Queries by name, each with its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridweave.plans.fixtures import duck, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: SQL of each image but the first under the id of the one before it.
NEXT = "n AS (SELECT b.* REPLACE (o.before AS image_id) FROM px b JOIN (SELECT image_id, lag(image_id) OVER (ORDER BY image_id) AS before FROM (SELECT DISTINCT image_id FROM px)) o USING (image_id) WHERE o.before IS NOT NULL)"


def add(name: str, fixture: str, fn: Callable[..., DataFrame], sql: str) -> None:
    """``fn`` gets the fixture; ``sql`` reads it as px."""
    QUERIES[name] = lambda spark, sf_dir: fn(load(spark, sf_dir, fixture))
    ORACLE_SQL[name] = f"WITH px AS ({duck(fixture)}) {sql}"
