"""Tables of the memory: columns of each entity and the fixed values of its enumerations."""

from __future__ import annotations

_TIMES = "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
_TEMPORAL = "temporal_state STRUCT<observed_at: STRING, valid_from: STRING, valid_to: STRING>"
_SUPPORT = "support_state STRUCT<level: STRING, evidence_count: INT, disagreeing_count: INT>"
_SCOPE = "scope STRUCT<domain: STRING, environment: STRING, condition: STRING>"

#: DDL of each table, as createDataFrame and reader schemas take it.
TABLES: dict[str, str] = {
    "sources": f"id STRING, type STRING, name STRING, trust_profile STRING, state STRING, tenant_id STRING, {_TIMES}",
    "source_items": f"id STRING, source_id STRING, external_id STRING, locator STRING, state STRING, current_version_id STRING, tenant_id STRING, {_TIMES}",
    "source_versions": "id STRING, source_item_id STRING, content_hash STRING, captured_at TIMESTAMP_NTZ, source_time STRING, content_ref STRING, metadata STRING, tenant_id STRING",
    "evidence": "id STRING, source_version_id STRING, segment_ref STRING, content_hash STRING, state STRING, tenant_id STRING, created_at TIMESTAMP_NTZ",
    "objects": f"id STRING, type STRING, name STRING, aliases ARRAY<STRING>, lifecycle_state STRING, redirect_to STRING, sensitivity STRING, tenant_id STRING, {_TIMES}",
    "claims": f"id STRING, subject_id STRING, predicate STRING, object_or_value STRING, value_num DOUBLE, evidence_refs ARRAY<STRING>, {_TEMPORAL}, lifecycle_state STRING, {_SUPPORT}, confidence DOUBLE, sensitivity STRING, tenant_id STRING, {_SCOPE}, {_TIMES}",
    "relationships": f"id STRING, source_object STRING, relation_type STRING, target_object STRING, evidence_refs ARRAY<STRING>, {_TEMPORAL}, lifecycle_state STRING, {_SUPPORT}, confidence DOUBLE, sensitivity STRING, tenant_id STRING, {_SCOPE}, {_TIMES}",
    "contexts": f"id STRING, type STRING, name STRING, purpose STRING, sensitivity STRING, tenant_id STRING, lifecycle_state STRING, {_TEMPORAL}, {_TIMES}",
    "memberships": "id STRING, context_id STRING, member_type STRING, member_id STRING, mode STRING, confidence DOUBLE, valid_from STRING, valid_to STRING, created_at TIMESTAMP_NTZ, tenant_id STRING",
    "gaps": "id STRING, type STRING, subject_id STRING, description STRING, evidence_refs ARRAY<STRING>, sensitivity STRING, tenant_id STRING, lifecycle_state STRING, created_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ",
    "provenance": "id STRING, assertion_type STRING, assertion_id STRING, evidence_id STRING, learned_at TIMESTAMP_NTZ, basis STRING",
    "candidates": "id STRING, type STRING, payload STRING, evidence_refs ARRAY<STRING>, extractor STRING, extractor_version STRING, created_at TIMESTAMP_NTZ",
    "decisions": "id STRING, candidate_ref STRING, verdict STRING, reasoning STRING, decision_model STRING, created_at TIMESTAMP_NTZ",
    "policies": "id STRING, decision_ref STRING, action STRING, acl_ref STRING, created_at TIMESTAMP_NTZ",
    "representations": "id STRING, type STRING, evidence_id STRING, generator STRING, generator_version STRING, content STRING, content_hash STRING, token_count INT, semantic_classes ARRAY<STRING>, created_at TIMESTAMP_NTZ",
    "journal": "sequence BIGINT, id STRING, logged_at STRING, entity_type STRING, entity_id STRING, operation STRING, payload_hash STRING, actor STRING",
    "segments": "id STRING, root_context STRING, included_objects ARRAY<STRING>, included_claims ARRAY<STRING>, included_relationships ARRAY<STRING>, included_contexts ARRAY<STRING>, included_evidence ARRAY<STRING>, purpose STRING, sensitivity STRING, version INT, payload_hash STRING, signature STRING, created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ",
    "redirects": "from_id STRING, into_id STRING",
    "closure": "alias STRING, canonical STRING",
    "agent_policies": "agent_id STRING, tenant_id STRING, max_sensitivity STRING, allowed_purposes ARRAY<STRING>",
}

# Enumerations of the data model.
SENSITIVITY = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}
OBJECT_STATES = ("active", "merged", "retired")
FACT_STATES = ("active", "superseded", "contradicted", "withdrawn")
PREDICATES = ("has_role", "has_property", "has_value")
RELATIONS = ("supersedes", "caused_by", "depends_on", "supports", "contradicts", "invalidates", "references", "belongs_to", "related_to")
MEMBER_TYPES = ("object", "claim", "relationship", "evidence", "context", "knowledge_gap")
GAP_TYPES = ("OpenQuestion", "MissingEvidence", "UnresolvedConflict", "UnknownDependency")
REPRESENTATIONS = ("summary", "essence_nl", "essence_structured", "embedding")
SCHEMA_VERSION = 1
