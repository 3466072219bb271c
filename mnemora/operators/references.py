"""References to records that are missing, withdrawn or recorded later (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.session import cut
from mnemora.sources.tables import current_objects

SALTS = 16


def object_parents(objects: DataFrame) -> DataFrame:
    """(parent, ref_key, gone, born) of each object; gone where its current row is retired."""
    now = current_objects(objects, "lifecycle_state", "created_at")
    return now.select(F.lit("object").alias("parent"), F.col("id").alias("ref_key"), F.coalesce(F.col("lifecycle_state") == "retired", F.lit(False)).alias("gone"), F.col("created_at").alias("born"))


def evidence_parents(evidence: DataFrame) -> DataFrame:
    """(parent, ref_key, gone, born) of each piece of evidence; repeated rows are one, gone if any says unavailable."""
    one = evidence.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.coalesce(F.col("state") == "unavailable", F.lit(False))).alias("gone"), F.min("created_at").alias("born"))
    return one.select(F.lit("evidence").alias("parent"), F.col("id").alias("ref_key"), "gone", "born")


def references(claims: DataFrame, relationships: DataFrame) -> DataFrame:
    """(parent, table_name, field_name, row_seq, ref_key, at) of every reference neither null nor empty."""

    def field(column: str, parent: str) -> Column:
        named = F.struct(F.lit(parent).alias("parent"), F.lit(column).alias("field_name"), F.col(column).alias("ref_key"))
        return F.when(F.col(column).isNotNull() & (F.col(column) != ""), named)

    def evidence(ref: Column) -> Column:
        return F.when(ref.isNotNull() & (ref != ""), F.struct(F.lit("evidence").alias("parent"), F.lit("evidence_refs").alias("field_name"), ref.alias("ref_key")))

    def exploded(rows: DataFrame, table: str, refs: Column) -> DataFrame:
        # one pass over a table: its fields side by side in an array, not a scan a field
        flat = rows.select(F.col("row_seq"), F.col("created_at").alias("at"), F.explode(F.filter(refs, lambda r: r.isNotNull())).alias("r"))
        return flat.select("r.parent", F.lit(table).alias("table_name"), "r.field_name", "row_seq", "r.ref_key", "at")

    listed = F.transform(F.array_distinct(F.coalesce(F.col("evidence_refs"), F.array().cast("array<string>"))), evidence)
    of_claims = exploded(claims, "claims", F.concat(F.array(field("subject_id", "object")), listed))
    return of_claims.unionByName(exploded(relationships, "relationships", F.array(field("source_object", "object"), field("target_object", "object"))))


def failing_references(refs: DataFrame, parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """(table_name, field_name, row_seq, ref_key, kind, period) of each reference that fails, without repeats.

    Distinct keys are aggregated before they are shuffled, so a key that a third of all rows name costs one row a
    task; they are written once and read by both joins with the parents. Keys that can fail no row (present, not gone, born before the first row naming them) leave here. What is
    left is joined back over (key, salt): the failing keys, few, are repeated once a salt; the rows of a hot key fall
    into ``salts`` tasks. ``period`` is ``unknown`` where the referring row has no time, and such a row is never late.
    """
    keys = cut(refs.groupBy("parent", "ref_key").agg(F.min("at").alias("first")))
    missing = keys.join(parents, ["parent", "ref_key"], "left_anti").select("parent", "ref_key", F.lit("missing").alias("fault"), F.lit(None).cast("timestamp_ntz").alias("born"))
    present = keys.join(parents, ["parent", "ref_key"], "inner").where(F.col("gone") | (F.col("born") > F.col("first")))
    held = present.select("parent", "ref_key", F.when(F.col("gone"), F.lit("deleted")).otherwise(F.lit("late")).alias("fault"), F.col("born").cast("timestamp_ntz").alias("born"))
    faults = missing.unionByName(held).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("row_seq"), F.lit(salts)).cast("int"))
    found = salted.join(faults, ["parent", "ref_key", "salt"]).where((F.col("fault") != "late") | (F.col("born") > F.col("at").cast("timestamp_ntz")))
    return found.select(
        "table_name", "field_name", "row_seq", "ref_key", F.col("fault").alias("kind"),
        F.coalesce(F.date_format(F.col("at").cast("timestamp_ntz"), "yyyy-MM"), F.lit("unknown")).alias("period"),
    ).distinct()


def failing_of(claims: DataFrame, relationships: DataFrame, objects: DataFrame, evidence: DataFrame) -> DataFrame:
    """``failing_references`` of the four reference fields of claims and relationships.

    Null and empty keys are no references; a key of blanks is one and is missing. A whole row repeated counts once.
    Empty tables give no rows, or every reference as missing.
    """
    return failing_references(references(claims, relationships), object_parents(objects).unionByName(evidence_parents(evidence)))


def failure_counts(failing: DataFrame) -> DataFrame:
    """Failing references per table, field, kind and month."""
    return failing.groupBy("table_name", "field_name", "kind", "period").agg(F.count("*").alias("refs"), F.countDistinct("ref_key").alias("keys"))
