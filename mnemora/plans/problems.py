"""Queries of the general data problems, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.operators import changefeed, hierarchy, intervals, references
from mnemora.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.periods_and_gaps(intervals.claim_intervals(table(spark, d, "claims")))
    return found.withColumnRenamed("key", "subject_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.failing_of(*(table(spark, d, t) for t in ("claims", "relationships", "objects", "evidence")))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.failure_counts(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.object_hierarchy(table(spark, d, "objects"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(p3_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_state(table(spark, d, "journal"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_counts, p3_found, p3_descendants, p5_found)}

_ISO = r"'^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$'"


def _utc(c: str) -> str:
    """SQL for the UTC time of an ISO text: its clock without offset, less the offset."""
    clock = rf"try_cast(replace(upper(regexp_replace({c}, '^(.{{10}}.+?)([Zz]|[+-]\d{{2}}(:?\d{{2}})?)$', '\1')), ',', '.') AS TIMESTAMP)"
    sign = rf"CASE regexp_extract({c}, '^.{{11}}.*([+-])\d{{2}}(:?\d{{2}})?$', 1) WHEN '-' THEN -1 WHEN '+' THEN 1 ELSE 0 END"
    hours = rf"coalesce(try_cast(regexp_extract({c}, '^.{{11}}.*[+-](\d{{2}})(:?\d{{2}})?$', 1) AS INTEGER), 0)"
    minutes = rf"coalesce(try_cast(regexp_extract({c}, '^.{{11}}.*[+-]\d{{2}}:?(\d{{2}})$', 1) AS INTEGER), 0)"
    return f"CASE WHEN regexp_matches({c}, {_ISO}) THEN {clock} - to_minutes({sign} * ({hours} * 60 + {minutes})) END"


_P1 = rf"""
WITH typed AS (
  SELECT subject_id AS k, {_utc("valid_from")} AS s,
         CASE WHEN valid_to IS NULL THEN TIMESTAMP '9999-12-31' ELSE {_utc("valid_to")} END AS e
  FROM claims WHERE subject_id IS NOT NULL AND subject_id <> ''),
held AS (SELECT * FROM typed WHERE s IS NOT NULL AND e IS NOT NULL AND e > s),
seen AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM held),
cut AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
periods AS (SELECT k, island, min(s) AS s, max(e) AS e FROM cut GROUP BY k, island),
both_kinds AS (
  SELECT k, 'period' AS kind, s, e FROM periods
  UNION ALL
  SELECT k, 'gap', e, nxt FROM (SELECT k, e, lead(s) OVER (PARTITION BY k ORDER BY s) AS nxt FROM periods) WHERE nxt IS NOT NULL)
SELECT k AS subject_id, kind, strftime(s, '%Y-%m-%dT%H:%M:%SZ') AS start_at,
       CASE WHEN e >= TIMESTAMP '9999-12-31' THEN 'open' ELSE strftime(e, '%Y-%m-%dT%H:%M:%SZ') END AS end_at
FROM both_kinds"""

_P2 = """
WITH o AS (
  SELECT id, arg_max(lifecycle_state, updated_at) = 'retired' AS gone, min(created_at) AS born FROM objects GROUP BY id),
v AS (SELECT id, bool_or(coalesce(state = 'unavailable', false)) AS gone, min(created_at) AS born FROM evidence GROUP BY id),
refs AS (
  SELECT 'claims' AS table_name, 'subject_id' AS field_name, row_seq, subject_id AS ref_key, created_at AS made FROM claims
  UNION ALL SELECT 'relationships', 'source_object', row_seq, source_object, created_at FROM relationships
  UNION ALL SELECT 'relationships', 'target_object', row_seq, target_object, created_at FROM relationships),
evs AS (SELECT 'claims' AS table_name, 'evidence_refs' AS field_name, row_seq, unnest(evidence_refs) AS ref_key, created_at AS made FROM claims),
judged AS (
  SELECT r.*, o.id AS found, o.gone, o.born FROM refs r LEFT JOIN o ON o.id = r.ref_key
  UNION ALL
  SELECT r.*, v.id, v.gone, v.born FROM evs r LEFT JOIN v ON v.id = r.ref_key),
failed AS (
  SELECT DISTINCT table_name, field_name, row_seq, ref_key,
    CASE WHEN found IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN born > made THEN 'late' END AS kind,
    coalesce(strftime(made, '%Y-%m'), 'unknown') AS period
  FROM judged WHERE ref_key IS NOT NULL AND ref_key <> '')
"""

_WALK = """
WITH RECURSIVE e AS (
  SELECT id, nullif(arg_max(coalesce(redirect_to, ''), updated_at), '') AS nx FROM objects WHERE id IS NOT NULL GROUP BY id),
walk AS (
  SELECT id, id AS node, 0 AS depth, [id] AS seen, false AS looped FROM e WHERE nx IS NOT NULL
  UNION ALL
  SELECT w.id, e.nx, w.depth + 1, list_append(w.seen, e.nx), list_contains(w.seen, e.nx)
  FROM walk w JOIN e ON e.id = w.node JOIN e AS t ON t.id = e.nx WHERE NOT w.looped),
ends AS (SELECT id, arg_max(node, depth) AS node, max(depth) AS depth, arg_max(seen, depth) AS seen, bool_or(looped) AS looped FROM walk GROUP BY id),
found AS (
  SELECT ends.id,
    CASE WHEN looped THEN list_min(seen[list_position(seen, node):]) ELSE node END AS root_id,
    CAST(CASE WHEN looped THEN list_position(seen, node) - 1 ELSE depth END AS INTEGER) AS depth,
    CASE WHEN looped THEN '' ELSE array_to_string(list_reverse(seen), '>') END AS path,
    CASE WHEN looped THEN (CASE WHEN node = ends.id THEN 'cycle' ELSE 'into_cycle' END) WHEN e.nx IS NULL THEN 'tree' ELSE 'broken' END AS status,
    CASE WHEN looped THEN NULL ELSE seen END AS seen
  FROM ends JOIN e ON e.id = ends.node)
"""

_P5 = r"""
WITH once AS (
  SELECT id, arg_min(entity_type, sequence) AS entity_type, arg_min(entity_id, sequence) AS entity_id, min(sequence) AS sequence,
         arg_min(coalesce(lower(regexp_replace(operation, '^\s+|\s+$', '', 'g')), ''), sequence) AS op
  FROM journal GROUP BY id),
ends AS (
  SELECT entity_type, entity_id,
    max(sequence) FILTER (WHERE op IN ('create', 'add_membership')) AS c,
    max(sequence) FILTER (WHERE op IN ('update', 'merge', 'resolve', 'mark_unavailable')) AS u,
    max(sequence) FILTER (WHERE op IN ('delete', 'remove_membership')) AS d
  FROM once GROUP BY entity_type, entity_id)
SELECT entity_type, entity_id, greatest(c, coalesce(u, c)) AS sequence FROM ends WHERE c IS NOT NULL AND (d IS NULL OR c > d)"""

SQL = {
    "p1_found": _P1,
    "p2_found": _P2 + "SELECT * FROM failed WHERE kind IS NOT NULL",
    "p2_counts": _P2 + "SELECT table_name, field_name, kind, period, count(*) AS refs, count(DISTINCT ref_key) AS keys FROM failed WHERE kind IS NOT NULL GROUP BY ALL",
    "p3_found": _WALK + "SELECT id, root_id, depth, path, status FROM found",
    "p3_descendants": _WALK + "SELECT seen[i + 1] AS ancestor, id AS descendant, CAST(i AS INTEGER) AS distance FROM (SELECT id, seen, unnest(range(1, len(seen))) AS i FROM found WHERE seen IS NOT NULL)",
    "p5_found": _P5,
}
