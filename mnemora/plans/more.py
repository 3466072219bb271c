"""More queries of the memory's own operators, each with its SQL: life cycles, segments, model answers, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import access, extraction, mutations, retrieval, segments
from mnemora.plans import memory
from mnemora.plans.memory_sql import _ALIASES, _CTX, _MEM, _O, _Q, _tokens, _words
from mnemora.plans.problems import _WALK
from mnemora.schema import PREDICATES, TABLES
from mnemora.session import shared_folder
from mnemora.sources import files, jdbc
from mnemora.sources.store import Store
from mnemora.sources.tables import table
from mnemora.streaming import replication

def _now() -> Column:
    return F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")


def context_create(spark: SparkSession, d: str) -> DataFrame:
    """Each source of the documents as a context, proposed once a spelling, beside the contexts of the journal."""
    rows = table(spark, d, "documents").where(F.col("source").isNotNull()).select("source").distinct()
    batch = rows.select(F.col("source").alias("ord"), F.lit("corpus").alias("type"), F.col("source").alias("name"), F.lit(None).cast("string").alias("purpose"), F.lit("secret").alias("sensitivity"), F.lit("default").alias("tenant_id"))
    out = mutations.create_contexts(batch, memory._contexts(spark, d))
    return out.accepted.select("id", "ord", "sensitivity", F.lit("").alias("error")).unionByName(out.rejected.select("id", "ord", "sensitivity", "error"))


def gaps_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every gap that the journal resolves, resolved among those that it creates."""
    rows = table(spark, d, "journal").where(F.col("entity_type") == "knowledge_gap")
    op = F.lower(F.trim("operation"))
    gaps = rows.where(op == "create").select(F.col("entity_id").alias("id"), F.lit("open").alias("lifecycle_state"), F.lit(None).cast("timestamp_ntz").alias("resolved_at")).distinct()
    batch = rows.where(op == "resolve").select(F.col("entity_id").alias("id")).distinct().withColumn("at", _now())
    out = mutations.resolve_gaps(batch, gaps)
    return out.accepted.select("id", "lifecycle_state", F.lit("").alias("error")).unionByName(out.rejected.select("id", "lifecycle_state", "error"))


def evidence_unavailable(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of evidence that a claim refers to, marked unavailable."""
    asked = table(spark, d, "claims").select(F.explode("evidence_refs").alias("id")).where(F.col("id").isNotNull()).distinct()
    held = table(spark, d, "evidence").where(F.col("id").isNotNull()).select("id", "content_hash", "tenant_id").distinct()
    out = mutations.mark_unavailable(asked, held)
    return out.accepted.select("id", "content_hash", "state", F.lit("").alias("error")).unionByName(out.rejected.select("id", "content_hash", "state", "error"))


def merge_through_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Every relationship between two objects as a request to merge its source into its target, ends followed first."""
    rows = table(spark, d, "relationships").select(F.col("row_seq").alias("ord"), F.col("source_object").alias("from_id"), F.col("target_object").alias("into_id"))
    asked = rows.where(F.col("from_id").isNotNull() & F.col("into_id").isNotNull()).distinct()
    out = mutations.merge_objects(asked, memory._objects(spark, d), memory._aliases(spark, d))
    kind = F.regexp_extract("error", "^M5 violated: (source not found|target not found|self-merge|already merged)", 1)
    return out.accepted.select("ord", "from_id", "into_id", F.lit("").alias("error")).unionByName(out.rejected.select("ord", "from_id", "into_id", kind.alias("error")))


def claim_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every claim row as a proposal to a memory that holds claims already."""
    rows = table(spark, d, "claims").select(F.col("row_seq").alias("ord"), F.lit("ClaimCandidate").alias("type"), "evidence_refs").dropDuplicates(["ord"])
    return extraction.decide(rows, 1).select("ord", "verdict", "reasoning", "action")


def relationship_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every relationship row as a proposal: verdicts, and what follows, as of once each."""
    rows = table(spark, d, "relationships").select(F.col("row_seq").alias("ord"), F.lit("RelationshipCandidate").alias("type"), "evidence_refs").dropDuplicates(["ord"])
    return extraction.decide(rows, 1).select("ord", "verdict", "action")


def undecided_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Mentions proposed as candidates of which those with evidence that is available are decided: the ones left."""
    rows = table(spark, d, "extracted_claims").select(F.col("mention_id").alias("id"), "evidence_id")
    decided = rows.join(table(spark, d, "evidence").where("state = 'available'").select(F.col("id").alias("evidence_id")).distinct(), "evidence_id", "left_semi").select(F.col("id").alias("candidate_ref"))
    return extraction.undecided(rows.select("id"), decided)


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each mention as a model would answer it, an envelope around JSON text, parsed: usable claims and errors."""
    inner = F.to_json(F.struct(F.array(F.struct(F.col("subject_name").alias("subjectName"), "predicate", F.col("object_or_value").alias("objectOrValue"), "confidence", "basis")).alias("claims")))
    body = F.when(F.col("subject_name").isNull(), F.lit("{not json")).when(F.trim("subject_name") == "", F.lit('{"error":"empty"}')).otherwise(F.to_json(F.struct(inner.alias("response"))))
    answers = table(spark, d, "extracted_claims").select("mention_id", body.alias("body"))
    got = extraction.parse_answers(answers, "mention_id", "body")
    return got.select("mention_id", "kind", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("relation", F.lit("")).alias("relation"), F.round("confidence", 6).alias("confidence"), F.coalesce("error", F.lit("")).alias("error"))


def embedding_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each stored vector as a model would answer it, every third one broken off, parsed."""
    whole = F.to_json(F.struct(F.array("embedding").alias("embeddings")))
    answers = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("body"))
    got = extraction.parse_embeddings(answers, "vec_id", "body")
    return got.select("vec_id", F.coalesce("dimensions", F.lit(0)).alias("dimensions"), F.round(F.coalesce(F.get("embedding", F.lit(0)), F.lit(0.0)), 4).alias("first"), F.coalesce("error", F.lit("")).alias("error"))


def entry_points_explained(spark: SparkSession, d: str) -> DataFrame:
    """Entry points among structured essences, with their explanation."""
    found = retrieval.entry_points(retrieval.represent(table(spark, d, "documents"), "doc_id", "text", "essence_structured"), "doc_id", memory.QUESTION)
    return found.select("doc_id", "explanation")


def representations_of_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Documents' representations beside the evidence that they are of."""
    made = retrieval.represent(table(spark, d, "documents").where(F.col("evidence_id").isNotNull()), "evidence_id", "text").select("evidence_id", "token_count")
    held = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), "state").distinct()
    return made.join(held, "evidence_id").groupBy("evidence_id", "state").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


def _expiring(spark: SparkSession, d: str, days: int | None, now: Column) -> DataFrame:
    return segments.export_segments(memory._contexts(spark, d), memory._memberships(spark, d), days, now)


def segment_expiry(spark: SparkSession, d: str) -> DataFrame:
    return _expiring(spark, d, 30, _now()).select("root_context", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


def segment_tampered(spark: SparkSession, d: str) -> DataFrame:
    """Segments that expired long ago, every other one's content changed after signing, at import."""
    odd = F.length("root_context") % 2 == 1
    rows = _expiring(spark, d, 1, _now()).withColumn("payload_hash", F.when(odd, F.concat("payload_hash", F.lit("x"))).otherwise(F.col("payload_hash")))
    out = segments.check_import(rows, segments.members(memory._memberships(spark, d)), {}, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), apply=False)
    return out.select("root_context", "verified", "applied", F.coalesce("error", F.lit("")).alias("error"))


def _store(spark: SparkSession, name: str) -> Store:
    return Store(spark, f"{shared_folder(spark).rstrip('/')}/{name}-{spark._jvm.java.util.UUID.randomUUID()}")


def _claim_batches(spark: SparkSession, d: str) -> Store:
    """The claims written to a store in two batches, by the parity of their months, each in order of arrival."""
    keyed = memory._claim_keys(spark, d).withColumn("id", F.col("key"))
    store = _store(spark, "claims")
    for half in (0, 1):
        store.commit({"claims": keyed.where(F.month("created_at") % 2 == half)}, order="row_seq")
    return store


def store_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return _claim_batches(spark, d).table("claims").select("id", "object_or_value", "lifecycle_state", "confidence")


def store_by_column(spark: SparkSession, d: str) -> DataFrame:
    """Upserted by column, after the store was compacted."""
    store = _claim_batches(spark, d)
    store.compact("claims")
    return store.table("claims", by_column=True).select("id", "object_or_value", "lifecycle_state", "confidence")


def store_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What the store held after its first batch."""
    return _claim_batches(spark, d).table("claims", version=1).select("id", "object_or_value")


def replication_applied(spark: SparkSession, d: str) -> DataFrame:
    """The journal pulled into an empty store in two rounds, and once more: counts, and what is held."""
    rows = table(spark, d, "journal")
    store = _store(spark, "journal")
    got = replication.pull_loop(store, lambda since: rows.where(F.col("sequence") > since), 2)
    again = replication.apply_events(store, rows)
    held = store.rows("journal").agg(F.count("*").alias("events"), F.countDistinct("id").alias("ids"), F.max("sequence").alias("last_sequence"))
    return held.select("events", "ids", "last_sequence", F.lit(got["applied"]).cast("long").alias("applied"), F.lit(again).cast("long").alias("again"))


def ingest_twice(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a name ingested as files of one source, and again: items, versions, evidence, what is skipped."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & F.col("external_id").isNotNull())
    found = docs.select(F.format_string("%012d", "doc_id").alias("path"), "external_id", F.col("text").alias("content"))
    empty = {t: spark.createDataFrame([], TABLES[t]) for t in ("source_items", "source_versions", "evidence")}
    first = files.ingest(found, "Docs", True, empty["source_items"], empty["source_versions"], empty["evidence"], _now())
    last = found.join(first["items"].select(F.col("locator").alias("path")), "path", "left_semi")
    second = files.ingest(last, "Docs", True, first["items"], first["versions"], first["evidence"], _now())
    return first["report"].withColumn("round", F.lit(1)).unionByName(second["report"].withColumn("round", F.lit(2)))


def database_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Claims of odd months upserted over those of even ones as a database does it: the tenant follows the last change."""
    keyed = memory._claim_keys(spark, d).withColumn("id", F.col("key"))
    columns = ("object_or_value", "lifecycle_state", "tenant_id")
    stored = mutations.latest(keyed.where(F.month("created_at") % 2 == 0), "id", "row_seq", list(columns)).drop("row_seq")
    return jdbc.upserted(stored, keyed.where(F.month("created_at") % 2 == 1).select("id", "row_seq", *columns), ("lifecycle_state",), "row_seq")


def json_columns(spark: SparkSession, d: str) -> DataFrame:
    """Claims to rows with JSON text and back: nothing changes."""
    rows = table(spark, d, "claims").select("id", "evidence_refs", "confidence")
    back = jdbc.decoded(jdbc.encoded(rows), "claims")
    return back.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("evidence_refs"), F.lit(0))).alias("refs"), F.round(F.max("confidence"), 6).alias("confidence"))


def contexts_readable(spark: SparkSession, d: str) -> DataFrame:
    """Which contexts may be read at which level."""
    levels = spark.createDataFrame([("public",), ("internal",), ("confidential",), ("restricted",)], "most string")
    contexts = memory._contexts(spark, d)
    parts = [access.context_gate(contexts, r["most"]).select("id", F.lit(r["most"]).alias("most"), "allowed") for r in levels.collect()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


QUERIES = {
    f.__name__: f
    for f in (
        context_create, gaps_resolve, evidence_unavailable, merge_through_redirects, claim_decisions, relationship_decisions, undecided_candidates, model_answers, embedding_answers,
        entry_points_explained, representations_of_evidence, segment_expiry, segment_tampered, store_last_wins, store_by_column, store_as_of, replication_applied, ingest_twice,
        database_upsert, json_columns, contexts_readable,
    )
}

_P = "(" + ", ".join(f"'{p}'" for p in PREDICATES) + ")"
_CLAIMS = "k AS (SELECT DISTINCT 'claim:' || subject_id || ':' || predicate AS id, row_seq, object_or_value, lifecycle_state, confidence, tenant_id, month(created_at) % 2 AS half FROM claims WHERE subject_id IS NOT NULL AND predicate IS NOT NULL)"
_CLAMPED = "round(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE least(1, greatest(0, confidence)) END, 6)"
SQL = {
    "context_create": rf"""WITH {_MEM}, {_CTX}, b AS (SELECT DISTINCT source AS ord, 'ctx:' || regexp_replace(lower(source), '\s+', '-', 'g') AS id FROM documents WHERE source IS NOT NULL),
f AS (SELECT *, min(ord) OVER (PARTITION BY id) AS first FROM b)
SELECT f.id, ord, 'internal' AS sensitivity, CASE WHEN ctx.id IS NOT NULL OR ord <> first THEN 'Context exists: ' || f.id || ' already exists' ELSE '' END AS error FROM f LEFT JOIN ctx ON ctx.id = f.id""",
    "gaps_resolve": """WITH g AS (SELECT DISTINCT entity_id AS id FROM journal WHERE entity_type = 'knowledge_gap' AND lower(trim(operation)) = 'create'),
r AS (SELECT DISTINCT entity_id AS id FROM journal WHERE entity_type = 'knowledge_gap' AND lower(trim(operation)) = 'resolve')
SELECT r.id, 'resolved' AS lifecycle_state, CASE WHEN g.id IS NULL THEN 'Gap not found: ' || r.id ELSE '' END AS error FROM r LEFT JOIN g USING (id)""",
    "evidence_unavailable": """WITH a AS (SELECT DISTINCT id FROM (SELECT unnest(evidence_refs) AS id FROM claims) WHERE id IS NOT NULL),
e AS (SELECT DISTINCT id, content_hash, tenant_id FROM evidence WHERE id IS NOT NULL)
SELECT a.id, content_hash, 'unavailable' AS state, CASE WHEN e.id IS NULL THEN 'Evidence not found: ' || a.id ELSE '' END AS error FROM a LEFT JOIN e USING (id)""",
    "merge_through_redirects": f"""{_WALK}{_ALIASES}, {_O},
q AS (SELECT DISTINCT row_seq AS ord, coalesce(x.canonical, source_object) AS from_id, coalesce(y.canonical, target_object) AS into_id
  FROM relationships LEFT JOIN aliases x ON x.alias = source_object LEFT JOIN aliases y ON y.alias = target_object WHERE source_object IS NOT NULL AND target_object IS NOT NULL),
f AS (SELECT *, min(ord) OVER (PARTITION BY from_id) AS first FROM q)
SELECT ord, from_id, into_id, CASE WHEN a.id IS NULL THEN 'source not found' WHEN b.id IS NULL THEN 'target not found' WHEN from_id = into_id THEN 'self-merge'
  WHEN coalesce(a.lifecycle_state, '') = 'merged' OR ord <> first THEN 'already merged' ELSE '' END AS error
FROM f LEFT JOIN o a ON a.id = from_id LEFT JOIN o b ON b.id = into_id""",
    "claim_decisions": """WITH r AS (SELECT row_seq AS ord, any_value(len(list_filter(coalesce(evidence_refs, []), lambda x: x IS NOT NULL))) AS n FROM claims GROUP BY row_seq)
SELECT ord, CASE WHEN n = 0 THEN 'Reject' WHEN n >= 2 THEN 'Accept' ELSE 'Escalate' END AS verdict,
  CASE WHEN n = 0 THEN 'No evidence attached' WHEN n >= 2 THEN n || ' evidence refs' ELSE 'Single evidence with existing claims — needs review' END AS reasoning,
  CASE WHEN n = 0 THEN 'Deny' WHEN n >= 2 THEN 'Allow' ELSE 'Quarantine' END AS action FROM r""",
    "relationship_decisions": """WITH r AS (SELECT row_seq AS ord, any_value(len(list_filter(coalesce(evidence_refs, []), lambda x: x IS NOT NULL))) AS n FROM relationships GROUP BY row_seq)
SELECT ord, CASE WHEN n = 0 THEN 'Reject' ELSE 'Accept' END AS verdict, CASE WHEN n = 0 THEN 'Deny' ELSE 'Allow' END AS action FROM r""",
    "undecided_candidates": "SELECT DISTINCT mention_id AS id FROM extracted_claims WHERE evidence_id IS NULL OR evidence_id NOT IN (SELECT id FROM evidence WHERE id IS NOT NULL AND state = 'available')",
    "model_answers": rf"""SELECT mention_id, 'claim' AS kind, trim(subject_name, ' ') AS a, predicate AS relation, {_CLAMPED} AS confidence, '' AS error
  FROM extracted_claims WHERE trim(subject_name, ' ') <> '' AND predicate IN {_P}
UNION ALL SELECT mention_id, 'error', '', '', NULL, CASE WHEN subject_name IS NULL THEN 'invalid JSON response' ELSE 'empty' END FROM extracted_claims WHERE subject_name IS NULL OR trim(subject_name, ' ') = ''""",
    "embedding_answers": """SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE len(embedding) END AS INTEGER) AS dimensions, round(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE CAST(embedding[1] AS DOUBLE) END, 4) AS first,
  CASE WHEN vec_id % 3 = 0 THEN 'response has no embedding' ELSE '' END AS error FROM embeddings""",
    "entry_points_explained": rf"""WITH w AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, CAST(to_json({{'topic': array_to_string(w[1:5], ' ')}}) AS VARCHAR) AS content FROM w), t AS (SELECT doc_id, {_tokens("content")} AS t FROM e),
h AS (SELECT doc_id, list_filter({_Q}, lambda q: list_contains(t, q)) AS hits FROM t)
SELECT doc_id, printf('%d (score=%.2f): matched: %s', doc_id, len(hits) / CAST(len({_Q}) AS DOUBLE), array_to_string(hits, ', ')) AS explanation FROM h WHERE len(hits) > 0""",
    "representations_of_evidence": f"""WITH w AS (SELECT evidence_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL AND evidence_id IS NOT NULL)
SELECT evidence_id, state, count(*) AS n, CAST(sum(len(w[1:greatest(1, len(w) // 4)])) AS BIGINT) AS tokens FROM w JOIN (SELECT DISTINCT id, state FROM evidence) e ON e.id = evidence_id GROUP BY evidence_id, state""",
    "segment_expiry": f"WITH {_MEM}, {_CTX} SELECT id AS root_context, '2025-07-01' AS expires FROM ctx",
    "segment_tampered": f"WITH {_MEM}, {_CTX} SELECT id AS root_context, length(id) % 2 = 0 AS verified, false AS applied, CASE WHEN length(id) % 2 = 0 THEN 'Segment expired: ' || id ELSE '' END AS error FROM ctx",
    "store_last_wins": f"WITH {_CLAIMS} SELECT id, object_or_value, lifecycle_state, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY half DESC, row_seq DESC) AS r FROM k) WHERE r = 1",
    "store_by_column": f"""WITH {_CLAIMS} SELECT a.id, a.object_or_value, b.lifecycle_state, b.confidence
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY half, row_seq) AS r FROM k) a JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY half DESC, row_seq DESC) AS r FROM k) b ON a.id = b.id WHERE a.r = 1 AND b.r = 1""",
    "store_as_of": f"WITH {_CLAIMS} SELECT id, object_or_value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_seq DESC) AS r FROM k WHERE half = 0) WHERE r = 1",
    "replication_applied": "SELECT count(DISTINCT id) AS events, count(DISTINCT id) AS ids, (SELECT max(s) FROM (SELECT min(sequence) AS s FROM journal WHERE id IS NOT NULL GROUP BY id)) AS last_sequence, count(DISTINCT id) AS applied, 0 AS again FROM journal",
    "ingest_twice": """WITH d AS (SELECT doc_id, external_id, sha256(text) AS h, substr(sha256(text), 1, 12) AS v FROM documents WHERE text IS NOT NULL AND external_id IS NOT NULL),
l AS (SELECT *, lag(v) OVER (PARTITION BY external_id ORDER BY doc_id) AS before FROM d),
c AS (SELECT * FROM l WHERE before IS NULL OR before <> v)
SELECT (SELECT count(DISTINCT external_id) FROM d) AS items_ingested, (SELECT count(*) FROM l WHERE before = v) AS skipped, (SELECT count(DISTINCT v) FROM c) AS versions_created,
  (SELECT count(DISTINCT v) FROM c) AS evidence_created, 0 AS quarantined, 1 AS round
UNION ALL SELECT 0, (SELECT count(DISTINCT external_id) FROM d), 0, 0, 0, 2""",
    "database_upsert": f"""WITH {_CLAIMS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_seq DESC, object_or_value DESC) AS r FROM k WHERE half = 0) WHERE r = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_seq DESC, object_or_value DESC) AS r FROM k WHERE half = 1) WHERE r = 1)
SELECT coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NULL THEN n.object_or_value ELSE s.object_or_value END AS object_or_value,
  CASE WHEN n.id IS NULL THEN s.lifecycle_state ELSE n.lifecycle_state END AS lifecycle_state, CASE WHEN n.id IS NULL THEN s.tenant_id ELSE n.tenant_id END AS tenant_id FROM s FULL JOIN n ON s.id = n.id""",
    "json_columns": "SELECT id, count(*) AS n, CAST(sum(coalesce(len(evidence_refs), 0)) AS BIGINT) AS refs, round(max(confidence), 6) AS confidence FROM claims GROUP BY id",
    "contexts_readable": f"""WITH {_MEM}, {_CTX}, l AS (SELECT * FROM (VALUES ('public', 0), ('internal', 1), ('confidential', 2), ('restricted', 3)) t(most, n))
SELECT id, l.most, r.n <= l.n AS allowed FROM ctx JOIN l r ON r.most = sensitivity, l""",
}
