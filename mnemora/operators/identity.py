"""Which object an id stands for once merges are followed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.operators.hierarchy import hierarchy


def closure(redirects: DataFrame, keep_cycles: bool = False) -> DataFrame:
    """(alias, canonical) of (from_id, into_id) redirects followed to their end.

    Of several redirects of one id the smallest target counts. Ids on or into a cycle have no canonical id: they are
    left out, or come with a null one (``keep_cycles``); ``cyclic`` lists them. Targets need not have a row.
    """
    edges = redirects.where(F.col("from_id").isNotNull() & F.col("into_id").isNotNull()).groupBy(F.col("from_id").alias("id")).agg(F.min("into_id").alias("next"))
    found = hierarchy(edges.withColumn("broken", F.lit(False)))
    ends = F.col("status").isin("tree", "broken")
    rows = found.select(F.col("id").alias("alias"), F.when(ends, F.col("root_id")).alias("canonical"))
    return rows if keep_cycles else rows.where(F.col("canonical").isNotNull())


def cyclic(redirects: DataFrame) -> DataFrame:
    """(id, error) of ids whose redirects never end."""
    return closure(redirects, keep_cycles=True).where(F.col("canonical").isNull()).select(F.col("alias").alias("id"), F.concat(F.lit("Circular redirect detected: "), "alias").alias("error"))


def object_redirects(current: DataFrame) -> DataFrame:
    """(from_id, into_id) of objects whose redirect is an id of another object."""
    known = current.select(F.col("id").alias("into_id"))
    return current.where(F.coalesce(F.col("redirect_to"), F.lit("")) != "").select(F.col("id").alias("from_id"), F.col("redirect_to").alias("into_id")).join(known, "into_id", "left_semi")


def resolve(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the id it stands for; an id without redirect stays."""
    lookup = aliases.select(F.col("alias").alias(column), F.col("canonical").alias("__canonical"))
    joined = rows.join(lookup, column, "left")
    return joined.select(*[(F.coalesce("__canonical", column).alias(column) if c == column else F.col(c)) for c in rows.columns])

