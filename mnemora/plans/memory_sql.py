"""The SQL that each query of ``memory`` equals."""

from __future__ import annotations

from mnemora.functions.text import query_tokens
from mnemora.operators.extraction import CAP, CLAIM_PATTERNS, RELATION_PATTERNS
from mnemora.plans.memory import END, HUB, KEYWORDS, QUESTION, START, UNTRUSTED
from mnemora.plans.problems import _WALK
from mnemora.schema import PREDICATES


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _tokens(text: str, camel: bool = True) -> str:
    t = rf"regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g')" if camel else text
    return f"list_filter(regexp_split_to_array(lower({t}), '[^a-zа-яё0-9]+'), lambda x: length(x) > 2)"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


_LEVELS = "['public', 'internal', 'confidential', 'restricted']"
_SRC = "coalesce(replace(lower(trim(source)), '_', '-'), 'none')"
_O = "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, lifecycle_state DESC) AS rn FROM objects WHERE id IS NOT NULL) WHERE rn = 1)"
_ALIASES = ", aliases AS (SELECT id AS alias, root_id AS canonical FROM found WHERE status IN ('tree', 'broken') AND depth > 0)"
_MEM = r"""mem AS (
  SELECT DISTINCT entity_id AS id, regexp_extract(entity_id, '^mem:(ctx:[^:]*):([a-z_]+):(.*)$', 1) AS context_id,
    regexp_extract(entity_id, '^mem:(ctx:[^:]*):([a-z_]+):(.*)$', 2) AS member_type, regexp_extract(entity_id, '^mem:(ctx:[^:]*):([a-z_]+):(.*)$', 3) AS member_id
  FROM journal WHERE entity_type = 'membership' AND regexp_matches(entity_id, '^mem:(ctx:[^:]*):([a-z_]+):(.*)$'))"""
_CTX = f"ctx AS (SELECT DISTINCT context_id AS id, {_LEVELS}[length(context_id) % 4 + 1] AS sensitivity FROM mem)"
_V = "v AS (SELECT id, bool_or(coalesce(state = 'unavailable', false)) AS gone FROM evidence WHERE id IS NOT NULL GROUP BY id)"


def _evidence_errors(table: str) -> str:
    return f"""
each AS (SELECT row_seq, unnest(evidence_refs) AS ref, unnest(range(1, len(evidence_refs) + 1)) AS at_no FROM (SELECT DISTINCT row_seq, evidence_refs FROM {table})),
bad AS (SELECT row_seq, at_no, CASE WHEN v.id IS NULL THEN 'Unknown evidence: ' || ref ELSE 'Evidence unavailable (quarantined): ' || ref END AS error
  FROM each LEFT JOIN v ON v.id = ref WHERE ref IS NOT NULL AND (v.id IS NULL OR v.gone)),
errors AS (SELECT row_seq, arg_min(error, at_no) AS error FROM bad GROUP BY row_seq)"""


_OBJ_BATCH = r"""batch AS (
  SELECT DISTINCT 'obj:' || regexp_replace(lower(name), '\s+', '-', 'g') AS id, type, name, updated_at, tenant_id, sensitivity AS raw,
    CASE WHEN sensitivity IN ('public', 'internal', 'confidential', 'restricted') THEN sensitivity ELSE 'internal' END AS sensitivity
  FROM objects WHERE name IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY updated_at, coalesce(type, ''), coalesce(tenant_id, ''), name) AS r FROM batch)"""
_KEYED = "k AS (SELECT DISTINCT 'claim:' || subject_id || ':' || predicate AS key, * FROM claims WHERE subject_id IS NOT NULL AND predicate IS NOT NULL)"
_EDGES = """edges AS (SELECT id AS edge_id, source_object AS source, target_object AS target, confidence AS c FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_seq DESC) AS rn FROM relationships WHERE id IS NOT NULL)
  WHERE rn = 1 AND lifecycle_state = 'active' AND source_object IS NOT NULL AND target_object IS NOT NULL)"""


def _paths(stop: str) -> str:
    return f"""
WITH RECURSIVE {_EDGES},
p AS (
  SELECT ['{START}'] AS nodes, CAST([] AS VARCHAR[]) AS ids, 0 AS hops, CAST(1 AS DOUBLE) AS score
  UNION ALL
  SELECT list_append(nodes, target), list_append(ids, edge_id), hops + 1, score * CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE least(1, greatest(0, c)) END
  FROM p JOIN edges ON source = nodes[-1] WHERE hops < 3 AND NOT list_contains(nodes, target){stop})
SELECT array_to_string(nodes, '>') AS path, array_to_string(ids, '|') AS edge_ids, CAST(hops AS INTEGER) AS hops, round(score, 6) AS score FROM p WHERE hops > 0"""


_WHOLE_PATHS = f"""{_WALK}{_ALIASES},
stands AS (SELECT coalesce(max(canonical) FILTER (alias = '{START}'), '{START}') AS a, coalesce(max(canonical) FILTER (alias = '{END}'), '{END}') AS b FROM aliases),
edges AS (SELECT id AS edge_id, coalesce(x.canonical, source_object) AS source, coalesce(y.canonical, target_object) AS target, confidence AS c FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_seq DESC) AS rn FROM relationships WHERE id IS NOT NULL)
  LEFT JOIN aliases x ON x.alias = source_object LEFT JOIN aliases y ON y.alias = target_object
  WHERE rn = 1 AND lifecycle_state = 'active' AND source_object IS NOT NULL AND target_object IS NOT NULL AND tenant_id = 'default'),
p AS (
  SELECT [a] AS nodes, CAST([] AS VARCHAR[]) AS ids, 0 AS hops, CAST(1 AS DOUBLE) AS score, b FROM stands
  UNION ALL
  SELECT list_append(nodes, target), list_append(ids, edge_id), hops + 1, score * CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE least(1, greatest(0, c)) END, b
  FROM p JOIN edges ON source = nodes[-1] WHERE hops < 4 AND NOT list_contains(nodes, target) AND nodes[-1] <> b)
SELECT array_to_string(nodes, '>') AS path, array_to_string(ids, '|') AS edge_ids, CAST(hops AS INTEGER) AS hops, round(score, 6) AS score FROM p WHERE nodes[-1] = b"""


def _dfs(tenant: str, depth: int, arrive: bool, start: str = "(SELECT a FROM stands)") -> str:
    """A depth-first walk as a recursive query: each step takes the top of the stack and, where a node is met for the
    first time and not too deep, puts its edges there, the first one uppermost."""
    only = f" AND tenant_id = '{tenant}'" if tenant else ""
    ends = "target = b OR target IN (SELECT alias FROM aliases WHERE canonical = b)" if arrive else "false"
    opens = f"x.d < {depth} AND NOT list_contains(visited, x.t) AND NOT x.arrives"
    step = "{'t': k.t, 'nodes': x.nodes || '>' || k.t, 'ids': CASE WHEN x.d = 0 THEN k.e ELSE x.ids || '|' || k.e END, 'ours': x.ours AND k.ours, 'score': x.score * k.p, 'd': x.d + 1, 'arrives': k.arrives}"
    return f"""{_WALK}{_ALIASES},
stands AS (SELECT coalesce(max(canonical) FILTER (alias = '{HUB}'), '{HUB}') AS a, coalesce(max(canonical) FILTER (alias = '{END}'), '{END}') AS b FROM aliases),
ed AS (SELECT id AS edge_id, source_object AS source, target_object AS target, ord, coalesce(tenant_id = 'default', false) AS ours,
    CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE least(1, greatest(0, confidence)) END AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_seq DESC) AS rn, min(row_seq) OVER (PARTITION BY id) AS ord FROM relationships WHERE id IS NOT NULL)
  WHERE rn = 1 AND lifecycle_state = 'active' AND source_object IS NOT NULL AND target_object IS NOT NULL{only}),
own AS (SELECT * FROM ed WHERE source NOT IN (SELECT alias FROM aliases)),
st AS (SELECT source AS at_node, * FROM own UNION ALL SELECT alias AS at_node, own.* FROM own JOIN aliases ON canonical = source),
kids AS (SELECT at_node, list({{'t': target, 'e': edge_id, 'p': CAST(p AS DOUBLE), 'ours': ours, 'arrives': {ends}}} ORDER BY ord DESC, edge_id DESC) AS ks FROM st, stands GROUP BY at_node),
w AS (
  SELECT 0 AS n, [{{'t': {start}, 'nodes': {start}, 'ids': '', 'ours': true, 'score': CAST(1 AS DOUBLE), 'd': 0, 'arrives': false}}] AS stack, CAST([] AS VARCHAR[]) AS visited,
    {{'t': '', 'nodes': '', 'ids': '', 'ours': true, 'score': CAST(1 AS DOUBLE), 'd': 0, 'arrives': false}} AS x
  UNION ALL
  SELECT n + 1, CASE WHEN {opens} AND ks IS NOT NULL THEN list_concat(stack, list_transform(ks, lambda k: {step})) ELSE stack END,
    CASE WHEN {opens} THEN list_append(visited, x.t) ELSE visited END, x
  FROM (SELECT n, stack[:-2] AS stack, visited, stack[-1] AS x FROM w WHERE len(stack) > 0) q LEFT JOIN kids ON at_node = q.x.t),
walked AS (SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS rank, x.nodes AS path, x.ids AS edge_ids, round(x.score, 6) AS score, x.ours AS ours FROM w WHERE x.d > 0{" AND x.arrives" if arrive else ""})
"""


def _regex(patterns: dict[str, str], label: str, cast: str, a: str, b: str, empty: str, need_both: bool) -> str:
    def one(i: int, p: str) -> str:
        p = p.replace("'", "''")
        z = rf"list_transform(list_zip(regexp_extract_all(t, '{p}', 1), regexp_extract_all(t, '{p}', 2)), lambda x: {{'a': regexp_replace(x[1], '^\s+|\s+$', '', 'g'), 'b': coalesce(regexp_replace(x[2], '^\s+|\s+$', '', 'g'), '')}})"
        return (f"list_filter({z}, lambda x: x.a <> '' AND x.b <> '')" if need_both else z) + f" AS m{i}"

    names = list(patterns)
    stages = [f"d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)", "s0 AS (SELECT doc_id, 0 AS n, " + ", ".join(one(i, patterns[k]) for i, k in enumerate(names)) + " FROM d)"]
    for i in range(len(names)):
        rest = ", ".join(f"m{j}" for j in range(i + 1, len(names)))
        done = ", ".join(f"t{j}" for j in range(i))
        cut = f"m{i}[1:greatest(1, {CAP} - n)]"
        stages.append(f"s{i + 1} AS (SELECT doc_id, n + len({cut}) AS n, {cut} AS t{i}{', ' + rest if rest else ''}{', ' + done if done else ''} FROM s{i})")
    parts = " UNION ALL ".join(f"SELECT doc_id, {cast.format(i=i, name=k)} AS {label}, unnest(t{i}) AS x, unnest(range(0, len(t{i}))) AS position FROM s{len(names)}" for i, k in enumerate(names))
    return f"WITH {', '.join(stages)}, r AS ({parts}) SELECT doc_id, {label}, CAST(position AS INTEGER) AS position, x.a AS {a}, CASE WHEN x.b = '' THEN '{empty}' ELSE x.b END AS {b} FROM r"


_Q = _list(query_tokens(QUESTION))
_K = _list(query_tokens(KEYWORDS))
_ESSENCE = f"es AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(w) AS whole, array_to_string(w[1:greatest(1, len(w) // 4)], ' ') AS content FROM es)"
_KC = f"kc AS (SELECT DISTINCT row_seq, id, subject_id FROM claims WHERE tenant_id = 'default' AND list_has_any({_tokens('concat_ws(chr(32), predicate, object_or_value)')}, {_K}))"
_KR = f"kr AS (SELECT DISTINCT row_seq, id, source_object, target_object FROM relationships WHERE tenant_id = 'default' AND list_contains({_K}, lower(relation_type)))"
_DECIDED = """f AS (SELECT min(mention_id) AS first FROM extracted_claims WHERE evidence_id IS NOT NULL),
dec AS (SELECT mention_id AS ord, evidence_id,
  CASE WHEN evidence_id IS NULL THEN 'Reject' WHEN mention_id > first THEN 'Escalate' ELSE 'Accept' END AS verdict FROM extracted_claims, f)"""
_RANK = "CASE sensitivity WHEN 'public' THEN 0 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 ELSE 1 END"

SQL = {
    "ingest_evidence": f"""WITH t AS (SELECT sha256(text) AS content_hash, {_SRC} NOT IN {_in(UNTRUSTED)} AS trusted FROM documents WHERE text IS NOT NULL)
      SELECT 'ev:' || substr(content_hash, 1, 12) AS id, content_hash, CASE WHEN bool_or(trusted) THEN 'available' ELSE 'unavailable' END AS state, count(*) AS copies FROM t GROUP BY content_hash""",
    "ingest_delta": f"""WITH a AS (SELECT {_SRC} AS source_id, external_id, sha256(text) AS h, captured_at, doc_id FROM documents WHERE text IS NOT NULL),
      l AS (SELECT *, lag(h) OVER (PARTITION BY source_id, external_id ORDER BY coalesce(captured_at, TIMESTAMP '1970-01-01'), doc_id) AS before FROM a)
      SELECT source_id, CASE WHEN external_id IS NULL OR before IS NULL THEN 'new' WHEN before = h THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM l GROUP BY ALL""",
    "quarantine_by_trust": f"SELECT {_SRC} AS source_id, CASE WHEN {_SRC} IN {_in(UNTRUSTED)} THEN 'unavailable' ELSE 'available' END AS state, count(*) AS n, count(text) AS with_text FROM documents GROUP BY ALL",
    "evidence_admissibility": f"WITH {_V}, {_evidence_errors('claims')} SELECT * FROM errors",
    "object_upsert": f"WITH {_OBJ_BATCH} SELECT DISTINCT id, type, name, sensitivity, tenant_id FROM ranked WHERE r = 1",
    "object_rejected": f"WITH {_OBJ_BATCH} SELECT 'M4 violated: ' || id || ' already exists' AS error, count(*) AS n FROM ranked WHERE r > 1 GROUP BY id",
    "claim_upsert_last_wins": f"WITH {_KEYED} SELECT key, object_or_value, lifecycle_state, confidence, row_seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_seq DESC) AS rn FROM k) WHERE rn = 1",
    "claim_upsert_keep_first": f"""WITH {_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_seq) AS f, row_number() OVER (PARTITION BY key ORDER BY row_seq DESC) AS l FROM k)
      SELECT a.key, a.object_or_value, a.valid_from, b.lifecycle_state, b.confidence, b.row_seq FROM r a JOIN r b ON a.key = b.key AND a.f = 1 AND b.l = 1""",
    "provenance_fanout": """WITH a AS (SELECT 'claim' AS assertion_type, id AS assertion_id, unnest(evidence_refs) AS evidence_id FROM claims
        UNION ALL SELECT 'relationship', id, unnest(evidence_refs) FROM relationships)
      SELECT DISTINCT 'prov:' || assertion_id || ':' || evidence_id AS id, assertion_type, assertion_id, evidence_id FROM a WHERE assertion_id IS NOT NULL AND evidence_id IS NOT NULL""",
    "claim_create": f"""{_WALK}{_ALIASES}, {_V}, {_evidence_errors('claims')},
      b AS (SELECT DISTINCT row_seq, subject_id, evidence_refs FROM claims),
      j AS (SELECT b.*, e.error, o.id AS known FROM b LEFT JOIN aliases ON alias = subject_id LEFT JOIN (SELECT DISTINCT id FROM objects) o ON o.id = coalesce(canonical, subject_id) LEFT JOIN errors e ON e.row_seq = b.row_seq)
      SELECT CASE WHEN error IS NOT NULL THEN split_part(error, ':', 1) WHEN known IS NULL THEN 'Subject object not found' WHEN coalesce(len(evidence_refs), 0) = 0 THEN 'M1 violated' ELSE 'accepted' END AS reason, count(*) AS n FROM j GROUP BY ALL""",
    "claim_create_rows": f"""{_WALK}{_ALIASES}, {_V}, {_evidence_errors('claims')},
      b AS (SELECT DISTINCT row_seq, subject_id, predicate, evidence_refs FROM claims),
      j AS (SELECT b.*, coalesce(canonical, subject_id) AS s, e.error AS bad, o.id AS known FROM b LEFT JOIN aliases ON alias = subject_id LEFT JOIN (SELECT DISTINCT id FROM objects) o ON o.id = coalesce(canonical, subject_id) LEFT JOIN errors e ON e.row_seq = b.row_seq)
      SELECT row_seq AS ord, concat_ws(':', 'claim', s, predicate) AS id, s AS subject_id, CAST(0.5 AS DOUBLE) AS confidence, 'weak' AS support, CAST(coalesce(len(evidence_refs), 0) AS INTEGER) AS evidence_count,
        CASE WHEN bad IS NOT NULL THEN bad WHEN known IS NULL THEN 'Subject object not found: ' || coalesce(s, 'null') WHEN coalesce(len(evidence_refs), 0) = 0 THEN 'M1 violated: no provenance for ' || concat_ws(':', 'claim', s, predicate) ELSE '' END AS error FROM j""",
    "relationship_create": f"""{_WALK}{_ALIASES}, {_V}, {_evidence_errors('relationships')}, k AS (SELECT DISTINCT id FROM objects),
      b AS (SELECT DISTINCT row_seq, source_object, relation_type, target_object, evidence_refs FROM relationships),
      j AS (SELECT b.*, coalesce(x.canonical, source_object) AS s, coalesce(y.canonical, target_object) AS t, e.error FROM b LEFT JOIN aliases x ON x.alias = source_object LEFT JOIN aliases y ON y.alias = target_object LEFT JOIN errors e ON e.row_seq = b.row_seq)
      SELECT row_seq AS ord, concat_ws(':', 'rel', s, relation_type, t) AS id FROM j JOIN k k1 ON k1.id = s JOIN k k2 ON k2.id = t WHERE error IS NULL AND coalesce(len(evidence_refs), 0) > 0""",
    "membership_add": f"""{_WALK}{_ALIASES}, {_MEM}, k AS (SELECT DISTINCT id FROM objects),
      j AS (SELECT mem.*, CASE WHEN member_type = 'object' THEN coalesce(canonical, member_id) ELSE member_id END AS m FROM mem LEFT JOIN aliases ON alias = member_id)
      SELECT j.id AS ord, concat_ws(':', 'mem', context_id, member_type, m) AS id, CASE WHEN member_type = 'object' AND k.id IS NULL THEN 'Object not found: ' || m ELSE '' END AS error FROM j LEFT JOIN k ON k.id = m""",
    "memberships_effective": f"""WITH {_MEM}, last AS (SELECT entity_id, arg_max(operation, sequence) AS op FROM journal WHERE entity_type = 'membership' AND operation IN ('add_membership', 'remove_membership') GROUP BY entity_id)
      SELECT id, context_id FROM mem WHERE id NOT IN (SELECT entity_id FROM last WHERE op = 'remove_membership')""",
    "merge_objects": f"""WITH {_O}, a AS (SELECT id AS from_id, redirect_to AS into_id FROM o WHERE redirect_to <> '' AND lifecycle_state <> 'merged')
      SELECT from_id, into_id, CASE WHEN t.id IS NULL THEN 'M5 violated: target not found: ' || into_id WHEN from_id = into_id THEN 'M5 violated: self-merge of ' || from_id ELSE '' END AS error FROM a LEFT JOIN o t ON t.id = into_id""",
    "redirect_closure": f"{_WALK}SELECT id AS alias, CASE WHEN status IN ('tree', 'broken') THEN root_id ELSE 'circular' END AS canonical FROM found WHERE NOT (status = 'broken' AND depth = 0)",
    "identity_resolved_edges": f"""{_WALK}{_ALIASES}, {_EDGES}
      SELECT coalesce(x.canonical, source) AS source, coalesce(y.canonical, target) AS target, count(*) AS n FROM edges LEFT JOIN aliases x ON x.alias = source LEFT JOIN aliases y ON y.alias = target GROUP BY ALL""",
    "regex_claims": _regex(dict(enumerate(CLAIM_PATTERNS)), "pattern_no", "CAST({i} AS INTEGER)", "subject_name", "object_or_value", "true", False),
    "regex_relationships": _regex(RELATION_PATTERNS, "relation_type", "'{name}'", "source_name", "target_name", "", True),
    "candidate_decision_policy": f"""WITH {_DECIDED} SELECT ord, verdict, CASE verdict WHEN 'Reject' THEN 'No evidence attached' WHEN 'Escalate' THEN 'Single evidence with existing claims — needs review' ELSE 'Single evidence, no conflicts' END AS reasoning,
      CASE verdict WHEN 'Accept' THEN 'Allow' WHEN 'Escalate' THEN 'Quarantine' ELSE 'Deny' END AS action FROM dec""",
    "extraction_counters": f"WITH {_DECIDED} SELECT evidence_id, count(*) AS candidates, count(*) FILTER (verdict = 'Accept') AS accepted, count(*) FILTER (verdict = 'Escalate') AS quarantined, count(*) FILTER (verdict = 'Reject') AS rejected FROM dec GROUP BY evidence_id",
    "extraction_name_lookup": rf"""WITH {_O}, n AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY created_at NULLS FIRST, id) AS r FROM o WHERE name IS NOT NULL),
      m AS (SELECT subject_name, count(*) AS mentions FROM extracted_claims WHERE subject_name IS NOT NULL GROUP BY subject_name)
      SELECT subject_name, mentions, coalesce(n.id, 'new ' || regexp_replace(lower(subject_name), '\s+', '-', 'g')) AS object_id FROM m LEFT JOIN n ON n.name = subject_name AND n.r = 1""",
    "llm_json_filter": rf"""WITH t AS (SELECT mention_id, regexp_replace(subject_name, '^\s+|\s+$', '', 'g') AS subject_name, predicate, confidence AS c FROM extracted_claims)
      SELECT mention_id, subject_name, predicate, round(CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE least(1, greatest(0, c)) END, 6) AS confidence FROM t WHERE subject_name <> '' AND predicate IN {_in(PREDICATES)}""",
    "essence_nl": f"WITH {_ESSENCE} SELECT doc_id, content, CAST(len({_words('content')}) AS INTEGER) AS token_count FROM e",
    "essence_structured": f"WITH {_ESSENCE} SELECT doc_id, array_to_string(w[1:5], ' ') AS topic, CAST(len({_words("array_to_string(w[1:5], ' ')")}) AS INTEGER) AS token_count FROM es",
    "entry_points": f"""WITH {_ESSENCE}, h AS (SELECT doc_id, {_tokens('content')} AS tk FROM e), s AS (SELECT doc_id, list_filter({_Q}, lambda q: list_contains(tk, q)) AS hits FROM h)
      SELECT doc_id, round(len(hits) / {float(len(query_tokens(QUESTION)))}, 6) AS score, array_to_string(hits, ', ') AS matched FROM s WHERE len(hits) > 0""",
    "entry_points_inverted": f"""WITH {_ESSENCE}, i AS (SELECT DISTINCT doc_id, unnest({_tokens('content')}) AS token FROM e), q AS (SELECT token, count(*) AS n FROM (SELECT unnest({_Q}) AS token) GROUP BY token)
      SELECT doc_id, round(sum(n) / {float(len(query_tokens(QUESTION)))}, 6) AS score FROM i JOIN q USING (token) GROUP BY doc_id""",
    "compression_ratio": f"WITH {_ESSENCE}, k AS (SELECT whole, len({_words('content')}) AS kept FROM e) SELECT CAST(sum(whole) AS BIGINT) AS words, CAST(sum(kept) AS BIGINT) AS kept_words, round(sum(whole) / sum(kept), 6) AS ratio FROM k",
    "semantic_recall": f"""WITH {_ESSENCE}, a AS (SELECT e.doc_id, list_distinct(list_filter({_tokens('content', False)}, lambda x: length(x) > 3)) AS asked, {_tokens('text', False)} AS all_tokens FROM e JOIN documents d ON d.doc_id = e.doc_id)
      SELECT doc_id, round(len(list_intersect(asked, all_tokens)) / greatest(1, len(asked)), 6) AS recall FROM a""",
    "hash_embeddings": f"""WITH t AS (SELECT doc_id, unnest({_tokens("coalesce(text, '')", False)}) AS token FROM documents), u AS (SELECT DISTINCT token FROM t),
      b AS (SELECT token, abs(list_reduce(list_transform(string_split(token, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT))) % 64 AS bucket FROM u),
      n AS (SELECT doc_id, bucket, count(*) AS c FROM t JOIN b USING (token) GROUP BY doc_id, bucket)
      SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS weight FROM n""",
    "cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 5) AS similarity FROM r WHERE rank <= 10""",
    "cosine_min_len": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
      SELECT vec_id, round(list_cosine_similarity(e[1:32], e[1:32]), 6) AS own_half, round(list_cosine_similarity(e[1:16], list_transform(range(16), lambda i: CAST(1 AS DOUBLE))), 6) AS ones FROM v""",
    "knowledge_claims": f"WITH {_KC} SELECT row_seq, id FROM kc",
    "knowledge_relationships": f"WITH {_KR} SELECT row_seq, id FROM kr",
    "knowledge_objects": f"WITH {_KC}, {_KR}, {_O}, ids AS (SELECT subject_id AS id FROM kc UNION SELECT source_object FROM kr UNION SELECT target_object FROM kr) SELECT id, name FROM o WHERE id IN (SELECT id FROM ids WHERE id IS NOT NULL)",
    "object_relationships": f"""WITH {_EDGES}, i AS (SELECT source AS id, 'out' AS direction FROM edges UNION ALL SELECT target, 'in' FROM edges)
      SELECT id, direction, count(*) AS n FROM i WHERE id IN (SELECT id FROM objects) GROUP BY ALL""",
    "claims_by_object": f"""{_WALK}{_ALIASES}, c AS (SELECT subject_id, count(DISTINCT row_seq) AS claims FROM claims WHERE subject_id IS NOT NULL GROUP BY subject_id),
      s AS (SELECT k.id, coalesce(canonical, k.id) AS canonical FROM (SELECT DISTINCT id FROM objects WHERE id IS NOT NULL) k LEFT JOIN aliases ON alias = k.id)
      SELECT id, canonical, claims FROM s JOIN c ON c.subject_id = canonical""",
    "traverse_paths": _paths(""),
    "multi_hop_paths": _paths(f" AND nodes[-1] <> '{END}'") + f" AND nodes[-1] = '{END}'",
    "multi_hop_paths_whole": _WHOLE_PATHS,
    "traverse_dfs": _dfs("", 3, False, f"'{HUB}'") + "SELECT rank, path, edge_ids, score FROM walked",
    "multi_hop_walk": _dfs("default", 4, True) + "SELECT rank, path, edge_ids, score FROM walked",
    "reconstruct_context": _dfs("", 3, False) + f""", {_O}
SELECT 'path' AS part, CAST(rank AS BIGINT) AS no, path AS id FROM walked WHERE ours
UNION ALL SELECT DISTINCT 'claim', row_seq, claims.id FROM claims, stands WHERE subject_id = a AND tenant_id = 'default'
UNION ALL SELECT 'object', 0, o.id FROM o, stands WHERE o.id = a AND tenant_id = 'default'""",
    "extract_batch": rf"""{_WALK}{_ALIASES}, {_O}, rr AS ({_regex(RELATION_PATTERNS, "relation_type", "'{name}'", "source_name", "target_name", "", True)}),
cc AS ({_regex(dict(enumerate(CLAIM_PATTERNS)), "pattern_no", "CAST({i} AS INTEGER)", "subject_name", "object_or_value", "true", False)}),
c1 AS (SELECT * FROM cc ORDER BY doc_id, pattern_no, position LIMIT 1),
named AS (SELECT DISTINCT name FROM (SELECT source_name AS name FROM rr UNION ALL SELECT target_name FROM rr UNION ALL SELECT subject_name FROM c1)),
held AS (SELECT name, arg_min(id, (created_at, id)) AS held FROM o WHERE name IS NOT NULL GROUP BY name),
k AS (SELECT named.name, held, 'obj:' || regexp_replace(lower(named.name), '\s+', '-', 'g') AS made FROM named LEFT JOIN held USING (name)),
ids AS (SELECT name, coalesce(canonical, coalesce(held, made)) AS id FROM k LEFT JOIN aliases ON alias = coalesce(held, made)),
objs AS (SELECT DISTINCT made AS id FROM k WHERE held IS NULL AND made NOT IN (SELECT id FROM o WHERE coalesce(lifecycle_state <> 'merged', true))),
rels AS (SELECT 'rel:' || x.id || ':' || relation_type || ':' || y.id AS id FROM rr JOIN ids x ON x.name = source_name JOIN ids y ON y.name = target_name),
cl AS (SELECT 'claim:' || x.id || ':has_role' AS id FROM c1 JOIN ids x ON x.name = subject_name),
n AS (SELECT (SELECT count(*) FROM rr) + (SELECT count(*) FROM cc) AS facts)
SELECT 'objects' AS part, id, 1 AS n FROM objs UNION ALL SELECT 'claims', id, count(*) FROM cl GROUP BY id UNION ALL SELECT 'relationships', id, count(*) FROM rels GROUP BY id
UNION ALL SELECT 'events', e, facts FROM n, (VALUES ('propose candidate'), ('decide decision'), ('apply_policy policy')) t(e) WHERE facts > 0
UNION ALL SELECT 'events', 'create object', count(*) FROM objs HAVING count(*) > 0 UNION ALL SELECT 'events', 'create claim', count(*) FROM cl HAVING count(*) > 0
UNION ALL SELECT 'events', 'create relationship', count(*) FROM rels HAVING count(*) > 0""",
    "context_claims": f"""WITH {_O}, c AS (SELECT subject_id, count(DISTINCT row_seq) AS claims, count(DISTINCT predicate) AS predicates FROM claims WHERE tenant_id = 'default' GROUP BY subject_id)
      SELECT id, name, coalesce(claims, 0) AS claims, coalesce(predicates, 0) AS predicates FROM o LEFT JOIN c ON subject_id = id WHERE tenant_id = 'default'""",
    "gaps_by_type": "SELECT regexp_extract(entity_id, '^gap:([^:]*):', 1) AS gap_type, count(DISTINCT entity_id) AS gaps, count(*) AS events FROM journal WHERE entity_type = 'knowledge_gap' GROUP BY ALL",
    "tenant_isolation": f"""WITH {_O} SELECT c.tenant_id, count(*) FILTER (c.tenant_id = o.tenant_id) AS own, count(*) AS facts FROM (SELECT DISTINCT row_seq, subject_id, tenant_id FROM claims) c JOIN o ON o.id = subject_id GROUP BY c.tenant_id""",
    "sensitivity_filter": f"SELECT tenant_id, {_RANK} AS level, count(*) AS n FROM claims WHERE {_RANK} <= 2 GROUP BY ALL",
    "acl_gate": f"WITH {_MEM}, {_CTX} SELECT id, sensitivity IN ('public', 'internal') AS allowed FROM ctx",
    "agent_policy_gate": f"""WITH a AS (SELECT DISTINCT actor AS agent_id FROM journal WHERE actor IS NOT NULL), q AS (SELECT agent_id, unnest({_LEVELS}) AS sensitivity FROM a),
      r AS (SELECT *, CASE WHEN agent_id = 'mcp' THEN 'no policy for agent and tenant' WHEN list_position({_LEVELS}, sensitivity) > length(agent_id) % 4 + 1 THEN 'sensitivity above policy limit'
        WHEN length(agent_id) % 2 = 0 THEN 'purpose not allowed' ELSE 'allowed' END AS reason FROM q)
      SELECT agent_id, sensitivity, reason = 'allowed' AS allowed, reason FROM r""",
    "agent_context": f"""{_WALK}{_ALIASES}, {_MEM}, {_O},
      seen AS (SELECT 'object' AS member_type, id FROM o WHERE tenant_id = 'default' AND {_RANK} <= 1 UNION SELECT 'evidence', id FROM evidence WHERE tenant_id = 'default'
        UNION SELECT 'claim', id FROM claims WHERE tenant_id = 'default' AND {_RANK} <= 1 UNION SELECT 'relationship', id FROM relationships WHERE tenant_id = 'default' AND {_RANK} <= 1),
      m AS (SELECT context_id, member_type, CASE WHEN member_type = 'object' THEN coalesce(canonical, member_id) ELSE member_id END AS member_id FROM mem LEFT JOIN aliases ON alias = member_id)
      SELECT context_id, m.member_type, member_id, count(*) AS n FROM m JOIN seen ON seen.member_type = m.member_type AND seen.id = member_id GROUP BY ALL""",
    "segment_export": f"""WITH {_MEM}, {_CTX}, l AS (SELECT context_id, count(*) FILTER (member_type = 'object') AS o, count(*) FILTER (member_type = 'claim') AS c FROM mem GROUP BY context_id),
      h AS (SELECT id AS root_context, concat_ws(':', id, o, c) AS payload_hash FROM ctx JOIN l ON context_id = id)
      SELECT root_context, payload_hash, 'sig:' || payload_hash AS signature, CAST(1 AS INTEGER) AS version FROM h""",
    "segment_members": f"WITH {_MEM} SELECT context_id AS root_context, member_type, member_id FROM mem WHERE member_type IN ('object', 'claim', 'relationship', 'context', 'evidence')",
    "segment_import_check": f"""WITH {_MEM}, {_CTX}, held AS (SELECT 'object' AS k, id FROM objects UNION SELECT 'claim', id FROM claims UNION SELECT 'relationship', id FROM relationships UNION SELECT 'evidence', id FROM evidence),
      gone AS (SELECT context_id, member_type, member_id, row_number() OVER (PARTITION BY context_id ORDER BY list_position(['object', 'claim', 'relationship', 'evidence'], member_type), member_id) AS r
        FROM mem WHERE member_type IN ('object', 'claim', 'relationship', 'evidence') AND NOT EXISTS (SELECT 1 FROM held WHERE k = member_type AND held.id = member_id))
      SELECT ctx.id AS root_context, true AS verified, context_id IS NULL AS applied, coalesce('Import: ' || member_type || ' not found locally: ' || member_id, '') AS error FROM ctx LEFT JOIN gone ON context_id = ctx.id AND r = 1""",
    "journal_since": "SELECT sequence, id, entity_type, entity_id, operation FROM journal WHERE sequence > (SELECT max(sequence) // 2 FROM journal)",
    "journal_sequence": "SELECT coalesce(max(sequence), 0) AS last_sequence FROM journal",
    "journal_apply": """WITH m AS (SELECT max(sequence) // 2 AS half FROM journal), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence, entity_type, entity_id) AS r FROM journal, m WHERE sequence > half * 4 // 5)
      SELECT id, sequence, entity_type, entity_id FROM f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM journal h, m WHERE h.sequence <= m.half AND h.id = f.id)""",
    "journal_renumbered": "SELECT id, was, row_number() OVER (ORDER BY was, id) AS sequence FROM (SELECT id, min(sequence) AS was FROM journal GROUP BY id)",
    "token_statistics": f"WITH t AS (SELECT doc_id, unnest({_tokens("coalesce(text, '')")}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS documents, count(*) AS times FROM t GROUP BY token",
    "confidence_clamp": "SELECT mention_id, round(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE least(1, greatest(0, confidence)) END, 6) AS confidence FROM extracted_claims",
}
