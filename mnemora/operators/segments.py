"""Portable parts of the memory: assembled, signed, checked, validated against what is held."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = {"object": "included_objects", "claim": "included_claims", "relationship": "included_relationships", "context": "included_contexts", "evidence": "included_evidence"}


def export_segments(contexts: DataFrame, memberships: DataFrame, expires_in_days: int | None, now: Column, signing: Callable[[Column], Column] | None = None) -> DataFrame:
    """One segment a context: payload hash, signature, version and expiry; its members stay rows (``members``).

    The hash covers the context and the numbers of objects and claims only, so members are counted, not gathered; 0
    days or none given means it never expires.
    """
    counts = memberships.groupBy("context_id").agg(*[F.count_if(F.col("member_type") == kind).cast("string").alias(kind) for kind in ("object", "claim")])
    rows = contexts.select(F.col("id").alias("root_context"), "sensitivity").join(counts, F.col("root_context") == F.col("context_id"), "left")
    hashed = rows.select("root_context", "sensitivity", F.concat_ws(":", "root_context", F.coalesce("object", F.lit("0")), F.coalesce("claim", F.lit("0"))).alias("payload_hash"))
    expiry = now + F.make_dt_interval(F.lit(expires_in_days)) if expires_in_days else F.lit(None).cast("timestamp")
    return hashed.withColumn("signature", (signing or sign)(F.col("payload_hash"))).withColumn("version", F.lit(1)).withColumn("expires_at", expiry)


def members(memberships: DataFrame) -> DataFrame:
    """(root_context, member_type, member_id) of what segments hold; gaps are left out."""
    return memberships.where(F.col("member_type").isin(*LISTS)).select(F.col("context_id").alias("root_context"), "member_type", "member_id")


def with_lists(segments: DataFrame, held: DataFrame) -> DataFrame:
    """Segments with their members as arrays in id order, as one stored row each; for single segments."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("member_type") == kind, F.col("member_id")))).alias(name) for kind, name in LISTS.items()]
    joined = segments.join(held.groupBy("root_context").agg(*lists), "root_context", "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.array().cast("array<string>")) for name in LISTS.values()})


def from_lists(segments: DataFrame) -> DataFrame:
    """``members`` of segments that carry arrays."""
    flat = None
    for kind, name in LISTS.items():
        one = segments.select("root_context", F.lit(kind).alias("member_type"), F.explode(name).alias("member_id"))
        flat = one if flat is None else flat.unionByName(one)
    return flat


def sign(payload_hash: Column) -> Column:
    return F.concat(F.lit("sig:"), payload_hash)


def verify(segments: DataFrame) -> Column:
    """Whether a segment's signature is that of its payload hash."""
    return F.col("signature") == sign(F.col("payload_hash"))


def check_import(segments: DataFrame, contents: DataFrame, held: dict[str, DataFrame], now: Column, apply: bool = True, verifying: Callable[[DataFrame], Column] = verify) -> DataFrame:
    """``segments`` with verified, applied and error; ``contents`` are their ``members``.

    A wrong signature verifies and applies nothing; an expired segment is an error; with ``apply`` the first member, by
    type (objects, claims, relationships, evidence) and id, that isn't held is one too. Contexts are not looked up.
    """
    staged = segments.withColumn("verified", F.coalesce(verifying(segments), F.lit(False))).withColumn("__expired", F.coalesce(F.col("expires_at") < now, F.lit(False)))
    staged = staged.withColumn("__missing", F.lit(None).cast("string"))
    if apply:
        each = None
        for order, kind in enumerate(("object", "claim", "relationship", "evidence")):
            one = contents.where(F.col("member_type") == kind).select("root_context", F.lit(order).alias("o"), F.col("member_id").alias("id"), F.lit(kind).alias("kind"))
            gone = one.join(held[kind].select("id"), "id", "left_anti").select("root_context", "o", "id", "kind")
            each = gone if each is None else each.unionByName(gone)
        first = each.groupBy("root_context").agg(F.min(F.struct("o", "id", "kind")).alias("m")).select("root_context", F.concat(F.lit("Import: "), "m.kind", F.lit(" not found locally: "), "m.id").alias("__gone"))
        staged = staged.join(first, "root_context", "left").withColumn("__missing", F.col("__gone")).drop("__gone")
    error = F.when(F.col("verified") & F.col("__expired"), F.concat(F.lit("Segment expired: "), "root_context")).when(F.col("verified"), F.col("__missing"))
    return staged.withColumn("error", error).withColumn("applied", F.lit(apply) & F.col("verified") & F.col("error").isNull()).drop("__expired", "__missing")
