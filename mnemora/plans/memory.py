"""Queries of the memory's own operators over the project's tables, each with its SQL.

Where the tables lack an entity it is read from what they hold: memberships, contexts and gaps from the journal's
entity ids, sources from the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import clamp, cosine, embedding_tokens, make_id, sensitivity_rank, slug, tokens, words
from mnemora.operators import access, extraction, graph, identity, mutations, retrieval, segments
from mnemora.operators.hierarchy import object_hierarchy
from mnemora.sources.files import classify, evidence_of
from mnemora.session import cut
from mnemora.sources.tables import current_objects, table

UNTRUSTED = ("vendor-mail", "partner-notes")
QUESTION = "Which DatabaseMigration was slower than the audit stream of the signing key, and why did the audit fail?"
KEYWORDS = "encrypted owner caused outage supersedes references"
START, END = "obj:release-coordination-group", "obj:common-ledger-store"
HUB = "obj:shared-operations-desk"


def _source(c: str = "source") -> Column:
    return F.coalesce(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")), F.lit("none"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return current_objects(table(spark, d, "objects"), "type", "name", "lifecycle_state", "redirect_to", "sensitivity", "tenant_id", "created_at")


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    found = object_hierarchy(table(spark, d, "objects"))
    return found.where(F.col("status").isin("tree", "broken") & (F.col("depth") > 0)).select(F.col("id").alias("alias"), F.col("root_id").alias("canonical"))


def _memberships(spark: SparkSession, d: str) -> DataFrame:
    """From journal ids ``mem:ctx:<name>:<type>:<member>``, once each."""
    ids = table(spark, d, "journal").where(F.col("entity_type") == "membership").select(F.col("entity_id").alias("id")).distinct()
    pattern = r"^mem:(ctx:[^:]*):([a-z_]+):(.*)$"
    parts = ids.select("id", *[F.regexp_extract("id", pattern, i).alias(n) for i, n in ((1, "context_id"), (2, "member_type"), (3, "member_id"))])
    return parts.where(F.col("context_id") != "")


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of memberships; their sensitivity goes by the length of the id."""
    levels = F.array(*map(F.lit, ("public", "internal", "confidential", "restricted")))
    return _memberships(spark, d).select(F.col("context_id").alias("id")).distinct().select("id", F.element_at(levels, (F.length("id") % 4 + 1).cast("int")).alias("sensitivity"))


# Sources -----------------------------------------------------------------------------------------------------------


def ingest_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence_of(_documents(spark, d), "text", ~_source().isin(*UNTRUSTED))


def ingest_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where(F.col("text").isNotNull())
    arriving = docs.select(_source().alias("source_id"), "external_id", F.sha2("text", 256).alias("content_hash"), F.coalesce("captured_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("captured_at"), "doc_id")
    return classify(arriving, ["captured_at", "doc_id"]).groupBy("source_id", "status").agg(F.count("*").alias("n"))


def quarantine_by_trust(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    state = F.when(_source().isin(*UNTRUSTED), F.lit("unavailable")).otherwise(F.lit("available"))
    return docs.groupBy(_source().alias("source_id"), state.alias("state")).agg(F.count("*").alias("n"), F.count("text").alias("with_text"))


def evidence_admissibility(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims").select("row_seq", "evidence_refs").distinct()
    return mutations.evidence_errors(rows, "row_seq", "evidence_refs", table(spark, d, "evidence"))


# Mutations ---------------------------------------------------------------------------------------------------------


def _object_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "objects").where(F.col("name").isNotNull())
    order = F.struct("updated_at", F.coalesce("type", F.lit("")), F.coalesce("tenant_id", F.lit("")), "name")
    return rows.select(order.alias("ord"), "type", "name", "sensitivity", "tenant_id").distinct()


def object_upsert(spark: SparkSession, d: str) -> DataFrame:
    empty = table(spark, d, "objects").where(F.lit(False))
    done = mutations.create_objects(_object_batch(spark, d), empty).accepted
    return done.select("id", "type", "name", "sensitivity", "tenant_id").distinct()


def object_rejected(spark: SparkSession, d: str) -> DataFrame:
    empty = table(spark, d, "objects").where(F.lit(False))
    return mutations.create_objects(_object_batch(spark, d), empty).rejected.groupBy("error").agg(F.count("*").alias("n"))


def _claim_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims").where(F.col("subject_id").isNotNull() & F.col("predicate").isNotNull()).distinct()
    return rows.withColumn("key", make_id("claim", F.col("subject_id"), F.col("predicate")))


def claim_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return mutations.latest(_claim_keys(spark, d), "key", "row_seq", ["object_or_value", "lifecycle_state", "confidence"])


def claim_upsert_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return mutations.first_kept(_claim_keys(spark, d), "key", "row_seq", ["object_or_value", "valid_from"], ["lifecycle_state", "confidence"])


def provenance_fanout(spark: SparkSession, d: str) -> DataFrame:
    claims, rels = (table(spark, d, t).where(F.col("id").isNotNull()) for t in ("claims", "relationships"))
    return mutations.provenance(claims, "claim").unionByName(mutations.provenance(rels, "relationship"))


def claim_create(spark: SparkSession, d: str) -> DataFrame:
    """Every claim row proposed anew to the store of objects and evidence: how many fail, and why."""
    batch = table(spark, d, "claims").select(F.col("row_seq").alias("ord"), "subject_id", "predicate", "object_or_value", "evidence_refs").dropDuplicates(["ord"])
    out = mutations.create_facts(batch, "claim", _objects(spark, d), table(spark, d, "evidence"), _aliases(spark, d))
    reason = F.regexp_extract("error", "^([^:]*)", 1)
    return out.rejected.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).unionByName(out.accepted.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n"))


def claim_create_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every claim row proposed anew, as ``claim_create`` counts them: what is stored of it, or its error."""
    batch = table(spark, d, "claims").select(F.col("row_seq").alias("ord"), "subject_id", "predicate", "object_or_value", "evidence_refs").dropDuplicates(["ord"])
    out = mutations.create_facts(batch, "claim", _objects(spark, d), table(spark, d, "evidence"), _aliases(spark, d))
    kept = ("ord", "id", "subject_id", "confidence", F.col("support_state.level").alias("support"), F.coalesce("support_state.evidence_count", F.lit(0)).alias("evidence_count"))
    return out.accepted.select(*kept, F.lit("").alias("error")).unionByName(out.rejected.select(*kept, "error"))


def relationship_create(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "relationships").select(F.col("row_seq").alias("ord"), "source_object", "relation_type", "target_object", "evidence_refs").dropDuplicates(["ord"])
    out = mutations.create_facts(batch, "rel", _objects(spark, d), table(spark, d, "evidence"), _aliases(spark, d))
    return out.accepted.select("ord", "id")


def membership_add(spark: SparkSession, d: str) -> DataFrame:
    batch = _memberships(spark, d).withColumnRenamed("id", "ord")
    out = mutations.add_memberships(batch, _contexts(spark, d), _objects(spark, d), _aliases(spark, d))
    return out.accepted.select("ord", "id", F.lit("").alias("error")).unionByName(out.rejected.select("ord", "id", "error"))


def memberships_effective(spark: SparkSession, d: str) -> DataFrame:
    return mutations.effective_memberships(_memberships(spark, d), table(spark, d, "journal")).select("id", "context_id")


def merge_objects(spark: SparkSession, d: str) -> DataFrame:
    """The recorded redirects of active objects as merge requests."""
    now = _objects(spark, d)
    asked = now.where((F.col("redirect_to") != "") & (F.col("lifecycle_state") != "merged")).select(F.col("id").alias("ord"), F.col("id").alias("from_id"), F.col("redirect_to").alias("into_id"))
    none = spark.createDataFrame([], "alias string, canonical string")
    out = mutations.merge_objects(asked, now, none)
    return out.accepted.select("from_id", "into_id", F.lit("").alias("error")).unionByName(out.rejected.select("from_id", "into_id", "error"))


# Identity ----------------------------------------------------------------------------------------------------------


def redirect_closure(spark: SparkSession, d: str) -> DataFrame:
    return identity.closure(identity.object_redirects(_objects(spark, d)), keep_cycles=True).select("alias", F.coalesce("canonical", F.lit("circular")).alias("canonical"))


def identity_resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    found = graph.resolved_edges(graph.edges(table(spark, d, "relationships")), _aliases(spark, d))
    return found.groupBy("source", "target").agg(F.count("*").alias("n"))


# Extraction --------------------------------------------------------------------------------------------------------


def regex_claims(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_claims(_documents(spark, d), "doc_id", "text").select("doc_id", "pattern_no", "position", "subject_name", "object_or_value")


def regex_relationships(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_relationships(_documents(spark, d), "doc_id", "text").select("doc_id", "relation_type", "position", "source_name", "target_name")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    refs = F.when(F.col("evidence_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("evidence_id"))
    rows = table(spark, d, "extracted_claims").select(F.col("mention_id").alias("ord"), "evidence_id", F.lit("ClaimCandidate").alias("type"), refs.alias("evidence_refs"))
    return extraction.decide(rows)


def candidate_decision_policy(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("ord", "verdict", "reasoning", "action")


def extraction_counters(spark: SparkSession, d: str) -> DataFrame:
    return extraction.outcome_counts(_decided(spark, d), "evidence_id")


def extraction_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The object each mention names exactly: the one recorded first of that very name, whatever its tenant."""
    by_name = _objects(spark, d).where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("created_at", "id")).alias("v")).select(F.col("name").alias("subject_name"), F.col("v.id").alias("object_id"))
    named = table(spark, d, "extracted_claims").select("subject_name").where(F.col("subject_name").isNotNull()).groupBy("subject_name").agg(F.count("*").alias("mentions"))
    return named.join(by_name, "subject_name", "left").select("subject_name", "mentions", F.coalesce("object_id", F.concat(F.lit("new "), slug(F.col("subject_name")))).alias("object_id"))


def llm_json_filter(spark: SparkSession, d: str) -> DataFrame:
    return extraction.usable_claims(table(spark, d, "extracted_claims")).select("mention_id", "subject_name", "predicate", F.round("confidence", 6).alias("confidence"))


# Representations ---------------------------------------------------------------------------------------------------


def essence_nl(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.represent(_documents(spark, d), "doc_id", "text").select("doc_id", "content", "token_count")


def essence_structured(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.represent(_documents(spark, d), "doc_id", "text", "essence_structured")
    return found.select("doc_id", F.get_json_object("content", "$.topic").alias("topic"), "token_count")


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.entry_points(retrieval.represent(_documents(spark, d), "doc_id", "text"), "doc_id", QUESTION)
    return found.select("doc_id", F.round("score", 6).alias("score"), "matched")


def entry_points_inverted(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.inverted_index(retrieval.represent(_documents(spark, d), "doc_id", "text"), "doc_id")
    return retrieval.entry_points_indexed(index, "doc_id", QUESTION).select("doc_id", F.round("score", 6).alias("score"))


def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where(F.col("text").isNotNull())
    essence = retrieval.represent(rows.select("doc_id", "text"), "doc_id", "text").select("doc_id", F.col("token_count").alias("kept"))
    joined = rows.select("doc_id", F.size(words(F.col("text"))).alias("whole")).join(essence, "doc_id")
    return joined.agg(F.sum("whole").alias("words"), F.sum("kept").alias("kept_words"), F.round(F.sum("whole") / F.sum("kept"), 6).alias("ratio"))


def semantic_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per document the share of its essence's distinct tokens of more than three letters found in its text."""
    rows = _documents(spark, d).where(F.col("text").isNotNull())
    essence = retrieval.represent(rows, "doc_id", "text").select("doc_id", "content")
    long = F.array_distinct(F.filter(embedding_tokens(F.col("content")), lambda t: F.length(t) > 3))
    joined = rows.select("doc_id", embedding_tokens(F.col("text")).alias("all")).join(essence.select("doc_id", long.alias("asked")), "doc_id")
    share = F.size(F.array_intersect("asked", "all")) / F.greatest(F.lit(1), F.size("asked"))
    return joined.select("doc_id", F.round(share, 6).alias("recall"))


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hash_embeddings(_documents(spark, d), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    found = retrieval.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)
    return found.select("query_id", "rank", "vec_id", F.round("similarity", 5).alias("similarity"))


def cosine_min_len(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside its own first half and a vector of ones: the shorter length counts."""
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", F.round(cosine(e, F.slice(e, F.lit(1), F.lit(32))), 6).alias("own_half"), F.round(cosine(e, F.array_repeat(F.lit(1.0), 16)), 6).alias("ones"))
    return rows


# Retrieval ---------------------------------------------------------------------------------------------------------


def knowledge_claims(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.matching_claims(table(spark, d, "claims").where(F.col("tenant_id") == "default"), KEYWORDS).select("row_seq", "id").distinct()


def knowledge_relationships(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.matching_relationships(table(spark, d, "relationships").where(F.col("tenant_id") == "default"), KEYWORDS).select("row_seq", "id").distinct()


def knowledge_objects(spark: SparkSession, d: str) -> DataFrame:
    ours = F.col("tenant_id") == "default"
    claims = retrieval.matching_claims(table(spark, d, "claims").where(ours), KEYWORDS)
    rels = retrieval.matching_relationships(table(spark, d, "relationships").where(ours), KEYWORDS)
    return retrieval.mentioned_objects(claims, rels, _objects(spark, d)).select("id", "name")


def object_relationships(spark: SparkSession, d: str) -> DataFrame:
    found = graph.incident(graph.edges(table(spark, d, "relationships")), _objects(spark, d))
    return found.groupBy("id", "direction").agg(F.count("*").alias("n"))


def claims_by_object(spark: SparkSession, d: str) -> DataFrame:
    """Claims held under the object each object stands for."""
    claims = table(spark, d, "claims").where(F.col("subject_id").isNotNull()).groupBy(F.col("subject_id").alias("canonical")).agg(F.countDistinct("row_seq").alias("claims"))
    stands = _objects(spark, d).select("id").join(_aliases(spark, d).select(F.col("alias").alias("id"), "canonical"), "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))
    return stands.join(claims, "canonical").select("id", "canonical", "claims")


def traverse_paths(spark: SparkSession, d: str) -> DataFrame:
    starts = spark.createDataFrame([(START,)], "id string")
    found = graph.simple_paths(graph.edges(table(spark, d, "relationships")), starts, 3)
    return found.select(F.array_join("nodes", ">").alias("path"), F.array_join("edge_ids", "|").alias("edge_ids"), "hops", F.round("score", 6).alias("score"))


def multi_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of three edges at most over every tenant's edges as recorded; ``multi_hop_paths_whole`` has the whole search."""
    found = graph.paths_between(graph.edges(table(spark, d, "relationships")), START, END, 3)
    return found.select(F.array_join("nodes", ">").alias("path"), F.array_join("edge_ids", "|").alias("edge_ids"), "hops", F.round("score", 6).alias("score"))


def multi_hop_paths_whole(spark: SparkSession, d: str) -> DataFrame:
    """Paths of up to four edges, as by default, of tenant ``default``, all ends followed through redirects."""
    aliases = _aliases(spark, d)
    stands = {r["alias"]: r["canonical"] for r in aliases.where(F.col("alias").isin(START, END)).collect()}
    found = graph.resolved_edges(graph.edges(table(spark, d, "relationships"), "default"), aliases)
    paths = graph.paths_between(found, stands.get(START, START), stands.get(END, END))
    return paths.select(F.array_join("nodes", ">").alias("path"), F.array_join("edge_ids", "|").alias("edge_ids"), "hops", F.round("score", 6).alias("score"))


def _walked(spark: SparkSession, d: str, tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges by every id that stands for their source, and the aliases."""
    aliases = cut(_aliases(spark, d))
    return graph.stepping(graph.edges(table(spark, d, "relationships"), tenant), aliases), aliases


def _canonical(aliases: DataFrame, *ids: str) -> list[str]:
    stands = {r["alias"]: r["canonical"] for r in aliases.where(F.col("alias").isin(*ids)).collect()}
    return [stands.get(i, i) for i in ids]


def traverse_dfs(spark: SparkSession, d: str) -> DataFrame:
    """The depth-first walk of up to three edges that expands each node once, merges followed at each step."""
    found, _ = _walked(spark, d)
    walked = graph.ordered_walk(found, spark.createDataFrame([(HUB,)], "id string"), 3)
    return walked.select("rank", F.array_join("nodes", ">").alias("path"), F.array_join("edge_ids", "|").alias("edge_ids"), F.round("score", 6).alias("score"))


def multi_hop_walk(spark: SparkSession, d: str) -> DataFrame:
    """The same walk of up to four edges of tenant ``default``, as far as it arrives at what END stands for, best first."""
    found, aliases = _walked(spark, d, "default")
    start, end = _canonical(aliases, HUB, END)
    walked = graph.ordered_walk(graph.standing_for(found, aliases, end), spark.createDataFrame([(start,)], "id string"), 4, end)
    return walked.select("rank", F.array_join("nodes", ">").alias("path"), F.array_join("edge_ids", "|").alias("edge_ids"), F.round("score", 6).alias("score"))


def reconstruct_context(spark: SparkSession, d: str) -> DataFrame:
    """What HUB stands for, its claims, and the paths of the walk from there all of whose edges are tenant ``default``'s.

    Gaps have no subject in these tables; those of a subject are tested on the memory itself.
    """
    found, aliases = _walked(spark, d)
    (at,) = _canonical(aliases, HUB)
    walked = graph.within_tenant(graph.ordered_walk(found, spark.createDataFrame([(at,)], "id string"), 3), "default")
    ours = F.col("tenant_id") == "default"
    claims = table(spark, d, "claims").where(ours & (F.col("subject_id") == at)).select(F.lit("claim").alias("part"), F.col("row_seq").alias("no"), "id").distinct()
    objects = _objects(spark, d).where(ours & (F.col("id") == at)).select(F.lit("object").alias("part"), F.lit(0).cast("long").alias("no"), "id")
    paths = walked.select(F.lit("path").alias("part"), F.col("rank").cast("long").alias("no"), F.array_join("nodes", ">").alias("id"))
    return paths.unionByName(claims).unionByName(objects)


def extract_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every document's facts through proposal, decision and policy into a memory that holds the objects: what is
    created, and the journal's events by kind."""
    texts = _documents(spark, d).where(F.col("text").isNotNull()).select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("evidence_id"), F.col("text").alias("content"), F.lit("default").alias("tenant_id"))
    objects = _objects(spark, d).withColumn("_first_seq", F.col("created_at"))
    out = extraction.extracted(texts, *extraction.by_patterns(texts), objects, _aliases(spark, d), 0)
    made = [out[t].groupBy(F.lit(t).alias("part"), "id").agg(F.count("*").alias("n")) for t in ("objects", "claims", "relationships")]
    events = out["events"].groupBy(F.lit("events").alias("part"), F.concat_ws(" ", "operation", "entity_type").alias("id")).agg(F.count("*").alias("n"))
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(events)


def context_claims(spark: SparkSession, d: str) -> DataFrame:
    """Per object of tenant ``default`` its claims of that tenant."""
    ours = F.col("tenant_id") == "default"
    claims = table(spark, d, "claims").where(ours & F.col("subject_id").isNotNull()).groupBy(F.col("subject_id").alias("id")).agg(F.countDistinct("row_seq").alias("claims"), F.countDistinct("predicate").alias("predicates"))
    return _objects(spark, d).where(ours).select("id", "name").join(claims, "id", "left").fillna(0, ["claims", "predicates"])


def gaps_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "journal").where(F.col("entity_type") == "knowledge_gap")
    return rows.groupBy(F.regexp_extract("entity_id", r"^gap:([^:]*):", 1).alias("gap_type")).agg(F.countDistinct("entity_id").alias("gaps"), F.count("*").alias("events"))


# Access ------------------------------------------------------------------------------------------------------------


def tenant_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose tenant is that of the object they are about, and those that cross."""
    tenants = _objects(spark, d).select(F.col("id").alias("subject_id"), F.col("tenant_id").alias("owner"))
    rows = table(spark, d, "claims").select("row_seq", "subject_id", "tenant_id").distinct().join(tenants, "subject_id")
    return rows.groupBy("tenant_id").agg(F.count_if(F.coalesce(F.col("tenant_id") == F.col("owner"), F.lit(False))).alias("own"), F.count("*").alias("facts"))


def sensitivity_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims").where(access.within(F.col("sensitivity"), "confidential"))
    return rows.groupBy("tenant_id", sensitivity_rank(F.col("sensitivity")).alias("level")).agg(F.count("*").alias("n"))


def acl_gate(spark: SparkSession, d: str) -> DataFrame:
    return access.context_gate(_contexts(spark, d), None).select("id", "allowed")


def agent_policy_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each actor of the journal asks for each level; one policy an actor, its limit going by the name's length."""
    actors = table(spark, d, "journal").where(F.col("actor").isNotNull()).select(F.col("actor").alias("agent_id")).distinct()
    levels = F.array(*map(F.lit, ("public", "internal", "confidential", "restricted")))
    policies = actors.where(F.col("agent_id") != "mcp").select("agent_id", F.lit("default").alias("tenant_id"), F.lit(1).alias("ord"), F.element_at(levels, (F.length("agent_id") % 4 + 1).cast("int")).alias("max_sensitivity"), F.when(F.length("agent_id") % 2 == 0, F.array(F.lit("audit"))).alias("allowed_purposes"))
    asked = actors.select("agent_id", F.lit("default").alias("tenant_id"), F.explode(levels).alias("sensitivity"), F.lit("review").alias("purpose"))
    return access.agent_gate(asked, policies).select("agent_id", "sensitivity", "allowed", "reason")


def agent_context(spark: SparkSession, d: str) -> DataFrame:
    members = _memberships(spark, d).withColumn("tenant_id", F.lit("default"))
    tables = {"object": _objects(spark, d), "evidence": table(spark, d, "evidence"), "claim": table(spark, d, "claims"), "relationship": table(spark, d, "relationships")}
    seen = retrieval.agent_members(members, tables, _aliases(spark, d), "default", access.within(F.col("sensitivity"), "internal"))
    return seen.groupBy("context_id", "member_type", "member_id").agg(F.count("*").alias("n"))


# Segments ----------------------------------------------------------------------------------------------------------


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.export_segments(_contexts(spark, d), _memberships(spark, d), None, F.current_timestamp())


def segment_export(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("root_context", "payload_hash", "signature", "version")


def segment_members(spark: SparkSession, d: str) -> DataFrame:
    return segments.members(_memberships(spark, d))


def segment_import_check(spark: SparkSession, d: str) -> DataFrame:
    held = {"object": _objects(spark, d), "claim": table(spark, d, "claims"), "relationship": table(spark, d, "relationships"), "evidence": table(spark, d, "evidence")}
    out = segments.check_import(_segments(spark, d), segments.members(_memberships(spark, d)), held, F.current_timestamp())
    return out.select("root_context", "verified", "applied", F.coalesce("error", F.lit("")).alias("error"))


# Journal -----------------------------------------------------------------------------------------------------------


def journal_since(spark: SparkSession, d: str) -> DataFrame:
    """The journal's later half, told by its own greatest sequence."""
    rows = table(spark, d, "journal")
    half = F.broadcast(rows.agg(F.expr("max(sequence) div 2").alias("half")))  # one row
    return rows.join(half, F.col("sequence") > F.col("half")).select("sequence", "id", "entity_type", "entity_id", "operation")


def journal_sequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "journal").agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("last_sequence"))


def journal_apply(spark: SparkSession, d: str) -> DataFrame:
    """A feed's later half, and a fifth of the first again, applied to a copy of its first half: what is added, each id once."""
    rows = table(spark, d, "journal")
    half = F.broadcast(rows.agg(F.expr("max(sequence) div 2").alias("half")))  # one row
    held = rows.join(half, F.col("sequence") <= F.col("half"))
    feed = rows.join(half, F.col("sequence") > F.expr("half * 4 div 5"))
    return mutations.insert_absent(feed.select("id", "sequence", "entity_type", "entity_id"), held, "id", "sequence")


def journal_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """The distinct changes numbered without holes."""
    from mnemora.operators.sequence import numbered

    rows = table(spark, d, "journal").groupBy("id").agg(F.min("sequence").alias("was"))
    return numbered(rows, ["was", "id"], "sequence").select("id", "was", "sequence")


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each token, and how often it comes."""
    rows = _documents(spark, d).select("doc_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("token"))
    per_doc = rows.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.count("*").alias("documents"), F.sum("n").alias("times"))


def confidence_clamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_claims").select("mention_id", F.round(clamp(F.col("confidence")), 6).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_evidence, ingest_delta, quarantine_by_trust, evidence_admissibility, object_upsert, object_rejected, claim_upsert_last_wins,
        claim_upsert_keep_first, provenance_fanout, claim_create, claim_create_rows, relationship_create, membership_add, memberships_effective, merge_objects,
        redirect_closure, identity_resolved_edges, regex_claims, regex_relationships, candidate_decision_policy, extraction_counters,
        extraction_name_lookup, llm_json_filter, essence_nl, essence_structured, entry_points, entry_points_inverted, compression_ratio,
        semantic_recall, hash_embeddings, cosine_topk, cosine_min_len, knowledge_claims, knowledge_relationships, knowledge_objects,
        object_relationships, claims_by_object, traverse_paths, multi_hop_paths, multi_hop_paths_whole, traverse_dfs, multi_hop_walk, reconstruct_context, extract_batch, context_claims, gaps_by_type,
        tenant_isolation, sensitivity_filter, acl_gate, agent_policy_gate, agent_context, segment_export, segment_members, segment_import_check,
        journal_since, journal_sequence, journal_apply, journal_renumbered, token_statistics, confidence_clamp,
    )
}
