"""Applying a feed of creations, changes and deletions to rebuild the current state (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The operations by what they do.
CREATES = ("create", "add_membership")
CHANGES = ("update", "merge", "resolve", "mark_unavailable")
REMOVES = ("delete", "remove_membership")


def effect(operation: Column) -> Column:
    """``c`` creates or replaces, ``u`` changes what exists, ``d`` removes, null has no effect; case and blanks aside."""
    op = F.lower(F.regexp_replace(operation, r"^\s+|\s+$", ""))
    return F.when(op.isin(*CREATES), F.lit("c")).when(op.isin(*CHANGES), F.lit("u")).when(op.isin(*REMOVES), F.lit("d"))


def deduplicated(feed: DataFrame) -> DataFrame:
    """(entity_type, entity_id, sequence, effect), one row per change id at its smallest sequence.

    Rows without sequence or entity are no changes. A row without id can't be recognised as repeated and stands for
    itself. Ties (one id twice at one sequence with other contents) are settled by entity and effect, smallest first.
    """
    rows = feed.select("id", "sequence", "entity_type", "entity_id", effect(F.col("operation")).alias("effect")).where(
        F.col("sequence").isNotNull() & F.col("entity_type").isNotNull() & F.col("entity_id").isNotNull()
    )
    first = F.min(F.struct("sequence", "entity_type", "entity_id", "effect")).alias("v")
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(first).select("v.*").unionByName(rows.where(F.col("id").isNull()).drop("id"))


def current_state(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(entity_type, entity_id, sequence) of the entities that exist after all changes.

    ``base``: entities that existed before the feed, as (entity_type, entity_id, sequence); none by default.

    An entity exists iff its last creation comes after its last removal, and the change that took effect last is then
    the later of its last creation and last change. So the latest row of each kind of effect decides, found by window
    ranking: a rank of one is limited inside each task before the exchange (WindowGroupLimit), which leaves at
    most three rows per entity and task of the longest feed.
    """
    changes = deduplicated(feed).where(F.col("effect").isNotNull())
    if base is not None:
        changes = changes.unionByName(base.select("entity_type", "entity_id", "sequence", F.lit("c").alias("effect")))
    latest = Window.partitionBy("entity_type", "entity_id", "effect").orderBy(F.col("sequence").desc())
    ranked = changes.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") == 1)
    last = {e: F.max(F.when(F.col("effect") == e, F.col("sequence"))) for e in "cud"}
    merged = ranked.groupBy("entity_type", "entity_id").agg(*[c.alias(e) for e, c in last.items()])
    lives = F.col("c").isNotNull() & (F.col("d").isNull() | (F.col("c") > F.col("d")))
    return merged.where(lives).select("entity_type", "entity_id", F.greatest("c", "u").alias("sequence"))
