"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_objects(objects: DataFrame, *columns: str) -> DataFrame:
    """The current row of each object: the version with the latest ``updated_at``.

    A hash aggregate with map-side combine, so many versions of one object never meet in one task as rows.
    Equal ``updated_at`` is settled by the values themselves, and a null ``updated_at`` is the oldest.
    """
    version = F.struct(F.col("updated_at"), *[F.col(c) for c in columns])
    newest = objects.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(version).alias("v"))
    return newest.select("id", *[F.col(f"v.{c}").alias(c) for c in columns])
