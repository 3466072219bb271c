"""Changes to the memory, a batch at a time.

Each takes a batch and the tables it depends on and gives ``Outcome``: the rows accepted, ready to be stored, and those
rejected, with the reason in ``error``. A batch's ``ord`` is the order in which its rows would have been handled one by
one; ``actor`` and, where it matters, ``tenant_id`` come with each row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import make_id, sensitivity, slug
from mnemora.operators.identity import resolve
from mnemora.operators.sequence import numbered


@dataclass
class Outcome:
    accepted: DataFrame
    rejected: DataFrame


def split(judged: DataFrame) -> Outcome:
    """By whether ``error`` is null."""
    return Outcome(judged.where(F.col("error").isNull()).drop("error"), judged.where(F.col("error").isNotNull()))


def first_error(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(None).cast("string")
    for when, text in reversed(pairs):
        out = F.when(when, text).otherwise(out)
    return out


def _default(batch: DataFrame, **columns: Column) -> DataFrame:
    for name, value in columns.items():
        batch = batch.withColumn(name, F.coalesce(F.col(name), value) if name in batch.columns else value)
    return batch


def create_named(batch: DataFrame, current: DataFrame, prefix: str, reusable: Column | None = None, label: str = "M4 violated") -> Outcome:
    """Objects (``obj``) and contexts (``ctx``): the id is the name's slug, and an id is given once.

    The first row of a batch with an id wins; an id held already is refused, unless its row is ``reusable``.
    """
    keyed = batch.withColumn("id", make_id(prefix, slug(F.col("name")))).withColumn("sensitivity", sensitivity(F.col("sensitivity")))
    held = current if reusable is None else current.where(~reusable)
    live = held.select("id", F.lit(True).alias("__held")).distinct()
    first = keyed.groupBy("id").agg(F.min("ord").alias("__first"))
    judged = keyed.join(live, "id", "left").join(first, "id")
    error = first_error(((F.col("__held").isNotNull()) | (F.col("ord") != F.col("__first")), F.concat(F.lit(f"{label}: "), "id", F.lit(" already exists"))))
    return split(judged.withColumn("error", error).drop("__held", "__first"))


def create_objects(batch: DataFrame, objects: DataFrame) -> Outcome:
    """From (ord, type, name, aliases, sensitivity, tenant_id, actor). A merged object's name may be used again."""
    rows = batch.withColumn("lifecycle_state", F.lit("active")).withColumn("redirect_to", F.lit(None).cast("string"))
    return create_named(rows, objects, "obj", F.coalesce(F.col("lifecycle_state") == "merged", F.lit(False)))


def create_contexts(batch: DataFrame, contexts: DataFrame) -> Outcome:
    """From (ord, type, name, purpose, sensitivity, tenant_id, actor)."""
    return create_named(batch.withColumn("lifecycle_state", F.lit("active")), contexts, "ctx", label="Context exists")


def evidence_errors(rows: DataFrame, key: str, refs: str, evidence: DataFrame) -> DataFrame:
    """(key, error): for each row the first reference, in order, that names no evidence or withdrawn evidence."""
    held = evidence.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.coalesce(F.col("state") == "unavailable", F.lit(False))).alias("gone"))
    each = rows.select(key, F.posexplode(refs).alias("at", "ref")).where(F.col("ref").isNotNull())
    bad = each.join(held.select(F.col("id").alias("ref"), "gone"), "ref", "left").where(F.col("gone").isNull() | F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.concat(F.lit("Unknown evidence: "), "ref")).otherwise(F.concat(F.lit("Evidence unavailable (quarantined): "), "ref"))
    return bad.groupBy(key).agg(F.min(F.struct("at", text.alias("error"))).alias("e")).select(key, F.col("e.error").alias("error"))


def create_facts(batch: DataFrame, kind: str, objects: DataFrame, evidence: DataFrame, aliases: DataFrame) -> Outcome:
    """Claims (``claim``: subject_id, predicate, object_or_value) or relationships (``rel``: source_object, relation_type,
    target_object), with ord, evidence_refs and what else the table holds.

    Ends are followed through redirects first. Refused, in this order: a reference to no or withdrawn evidence, an end
    that is no object, no evidence at all. Accepted rows carry their id; one id accepted twice stays twice, in order:
    the store's policy decides which counts.
    """
    ends = ("subject_id",) if kind == "claim" else ("source_object", "target_object")
    names = {"subject_id": "Subject object", "source_object": "Source object", "target_object": "Target object"}
    rows = batch
    for end in ends:
        rows = resolve(rows, end, aliases)
    known = objects.select("id").where(F.col("id").isNotNull()).distinct()
    for end in ends:
        rows = rows.join(known.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    rows = rows.join(evidence_errors(batch, "ord", "evidence_refs", evidence).withColumnRenamed("error", "__evidence"), "ord", "left")
    ids = make_id("claim", F.col("subject_id"), F.col("predicate")) if kind == "claim" else make_id("rel", F.col("source_object"), F.col("relation_type"), F.col("target_object"))
    error = first_error(
        (F.col("__evidence").isNotNull(), F.col("__evidence")),
        *[(F.col(f"__{e}").isNull(), F.concat(F.lit(f"{names[e]} not found: "), F.coalesce(e, F.lit("null")))) for e in ends],
        (F.coalesce(F.size("evidence_refs"), F.lit(0)) == 0, F.concat(F.lit("M1 violated: no provenance for "), ids)),
    )
    judged = rows.withColumn("id", ids).withColumn("error", error).drop("__evidence", *[f"__{e}" for e in ends])
    level = F.struct(F.lit("weak").alias("level"), F.size("evidence_refs").alias("evidence_count"), F.lit(0).alias("disagreeing_count"))
    return split(_default(judged, lifecycle_state=F.lit("active"), confidence=F.lit(0.5), support_state=level))


def provenance(facts: DataFrame, kind: str) -> DataFrame:
    """(id, assertion_type, assertion_id, evidence_id): one row a fact and piece of evidence, first write kept."""
    each = facts.select(F.col("id").alias("assertion_id"), F.explode(F.array_distinct("evidence_refs")).alias("evidence_id")).where(F.col("evidence_id").isNotNull()).distinct()
    return each.select(make_id("prov", F.col("assertion_id"), F.col("evidence_id")).alias("id"), F.lit(kind).alias("assertion_type"), "assertion_id", "evidence_id")


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key wins whole."""
    v = F.max(F.struct(order, *columns)).alias("v")
    return rows.groupBy(key).agg(v).select(key, *[F.col(f"v.{c}").alias(c) for c in columns], F.col(f"v.{order}").alias(order))


def first_kept(rows: DataFrame, key: str, order: str, fixed: list[str], changing: list[str]) -> DataFrame:
    """Upsert by column: ``fixed`` columns keep the first row's values, ``changing`` ones take the last row's."""
    a, b = F.min(F.struct(order, *fixed)).alias("a"), F.max(F.struct(order, *changing)).alias("b")
    return rows.groupBy(key).agg(a, b).select(key, *[F.col(f"a.{c}").alias(c) for c in fixed], *[F.col(f"b.{c}").alias(c) for c in changing], F.col(f"b.{order}").alias(order))


def insert_absent(rows: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key isn't stored yet, the first of each."""
    fresh = rows.join(stored.select(key), key, "left_anti")
    others = [c for c in rows.columns if c not in (key, order)]
    return fresh.groupBy(key).agg(F.min(F.struct(order, *others)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in (order, *others)])


def add_memberships(batch: DataFrame, contexts: DataFrame, objects: DataFrame, aliases: DataFrame) -> Outcome:
    """From (ord, context_id, member_type, member_id, mode, tenant_id, actor): the context must exist; members that are
    objects are followed through redirects and must exist, others are taken as they are."""
    is_object = F.col("member_type") == "object"
    rows = batch.join(aliases.select(F.col("alias").alias("member_id"), "canonical"), "member_id", "left").withColumn("member_id", F.when(is_object, F.coalesce("canonical", "member_id")).otherwise(F.col("member_id"))).drop("canonical")
    rows = rows.join(contexts.select(F.col("id").alias("context_id"), F.lit(True).alias("__c")).distinct(), "context_id", "left")
    rows = rows.join(objects.select(F.col("id").alias("member_id"), F.lit(True).alias("__o")).distinct(), "member_id", "left")
    error = first_error((F.col("__c").isNull(), F.concat(F.lit("Context not found: "), "context_id")), (is_object & F.col("__o").isNull(), F.concat(F.lit("Object not found: "), "member_id")))
    judged = rows.withColumn("id", make_id("mem", F.col("context_id"), F.col("member_type"), F.col("member_id"))).withColumn("error", error).drop("__c", "__o")
    return split(_default(judged, confidence=F.lit(0.5)))


def effective_memberships(memberships: DataFrame, journal: DataFrame) -> DataFrame:
    """Memberships whose last event is no removal: removing leaves the row and only writes the journal."""
    ended = journal.where((F.col("entity_type") == "membership") & F.col("operation").isin("add_membership", "remove_membership"))
    last = ended.groupBy(F.col("entity_id").alias("id")).agg(F.max_by("operation", "sequence").alias("op")).where(F.col("op") == "remove_membership")
    return memberships.join(last, "id", "left_anti")


def resolve_gaps(batch: DataFrame, gaps: DataFrame) -> Outcome:
    """From (id, actor, at): the gap, now resolved; resolving again is allowed, an unknown gap refused."""
    joined = batch.join(gaps.withColumn("__g", F.lit(True)), "id", "left").withColumn("lifecycle_state", F.lit("resolved")).withColumn("resolved_at", F.col("at"))
    return split(joined.withColumn("error", first_error((F.col("__g").isNull(), F.concat(F.lit("Gap not found: "), "id")))).drop("__g"))


def merge_objects(batch: DataFrame, objects: DataFrame, aliases: DataFrame) -> Outcome:
    """From (ord, from_id, into_id, actor): redirects to be added, ends followed first.

    Refused: an unknown end, an object merged already, and an object into itself. Of several merges of one object the
    first counts.
    """
    rows = resolve(resolve(batch, "from_id", aliases), "into_id", aliases)
    state = objects.select("id", F.col("lifecycle_state").alias("state"))
    rows = rows.join(state.select(F.col("id").alias("from_id"), F.col("state").alias("__f"), F.lit(True).alias("__hf")), "from_id", "left")
    rows = rows.join(state.select(F.col("id").alias("into_id"), F.lit(True).alias("__hi")), "into_id", "left")
    first = rows.groupBy("from_id").agg(F.min("ord").alias("__first"))
    rows = rows.join(first, "from_id")
    error = first_error(
        (F.col("__hf").isNull(), F.concat(F.lit("M5 violated: source not found: "), "from_id")),
        (F.col("__hi").isNull(), F.concat(F.lit("M5 violated: target not found: "), "into_id")),
        (F.col("from_id") == F.col("into_id"), F.concat(F.lit("M5 violated: self-merge of "), "from_id")),
        ((F.coalesce("__f", F.lit("")) == "merged") | (F.col("ord") != F.col("__first")), F.concat(F.lit("M5 violated: already merged: "), "from_id")),
    )
    return split(rows.withColumn("error", error).drop("__f", "__hf", "__hi", "__first"))


def mark_unavailable(batch: DataFrame, evidence: DataFrame) -> Outcome:
    """From (id, actor): the evidence, now unavailable; what it supports stays."""
    joined = batch.join(evidence.withColumn("__e", F.lit(True)), "id", "left").withColumn("state", F.lit("unavailable"))
    return split(joined.withColumn("error", first_error((F.col("__e").isNull(), F.concat(F.lit("Evidence not found: "), "id")))).drop("__e"))


def journal_rows(changes: DataFrame, order: list[str], last_sequence: int, at: Column) -> DataFrame:
    """Journal events of (entity_type, entity_id, operation, actor) changes, numbered on from ``last_sequence``."""
    rows = numbered(changes, order, "sequence", last_sequence + 1)
    return rows.select(
        "sequence", make_id("event", F.col("sequence").cast("string")).alias("id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("logged_at"),
        "entity_type", "entity_id", "operation", F.concat_ws(":", "entity_type", "entity_id", "operation").alias("payload_hash"), "actor",
    )
