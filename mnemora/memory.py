"""The memory's operations one call at a time: each a batch of one row over the set-at-a-time operators.

Errors come as ``MemoryError_`` with the operator's text. Every change is one published batch, its journal event in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import access, extraction, graph, identity, mutations, retrieval, segments
from mnemora.schema import TABLES
from mnemora.sources import files
from mnemora.sources.store import Store


class MemoryError_(ValueError):
    """A change that the memory refuses."""


def number_text(x: float) -> str:
    """A number as JSON writes it: whole ones without a point, others with as many digits as tell them apart."""
    if float(x).is_integer() and abs(x) < 1e21:
        return str(x) if isinstance(x, int) else format(Decimal(repr(x)), "f").removesuffix(".0")
    text = repr(float(x))
    if "e" not in text and 0 < abs(x) < 1e-6:
        text = f"{x:e}"
    digits, _, power = text.partition("e")
    return f"{digits.removesuffix('.0')}e{'+' if int(power) > 0 else '-'}{abs(int(power))}" if power else text


class Memory:
    """``clock`` gives the time of a change; fixed in tests. The other functions are the models, each over DataFrames:

    ``gate`` (contexts, most) who may read a context; ``agent_gate`` (requests, policies) which agent may; ``extract``
    (texts) claims and relationships; ``decide`` (candidates, claims held) with verdict and reasoning; ``policy``
    (decisions) with action and acl_ref; ``represent`` (texts, key, text, kind); ``embed`` (texts, key, text); ``sign``
    and ``verify``, columns of a segment's payload hash and of its row. Without one the operators' own is used.
    ``slow_model``: extraction asked for as asynchronous, by a model service as a rule; none unless given.
    """

    def __init__(
        self, spark: SparkSession, folder: str, clock=lambda: datetime.now(timezone.utc).replace(tzinfo=None), gate: Callable | None = None, *, agent_gate: Callable = access.agent_gate,
        extract: Callable = extraction.by_patterns, decide: Callable = extraction.verdicts, policy: Callable = extraction.actions, represent: Callable = retrieval.represent,
        embed: Callable = retrieval.hash_embeddings, sign: Callable = segments.sign, verify: Callable = segments.verify, slow_model: Callable | None = None,
    ) -> None:
        self.spark, self.store, self.clock = spark, Store(spark, folder), clock
        self.gate, self.agent_gate = gate or access.context_gate, agent_gate
        self.extraction_model, self.decision_model, self.policy_model = extract, decide, policy
        self.representation_model, self.embedding_model, self.sign, self.verify = represent, embed, sign, verify
        self.slow_model = slow_model

    # Helpers ---------------------------------------------------------------------------------------------------

    def _row(self, schema: str, **values) -> DataFrame:
        names = [c.strip().split()[0] for c in schema.split(";")]
        return self.spark.createDataFrame([tuple(values.get(n) for n in names)], schema.replace(";", ","))

    def _event(self, operation: str, kind: str, entity_id: str, actor: str, *then: str) -> DataFrame:
        """One event, and one more for each operation in ``then``."""
        n, at = self.store.last_sequence() + 1, self.clock().isoformat(timespec="milliseconds") + "Z"
        events = [(n + i, f"event:{n + i}", at, kind, entity_id, o, f"{kind}:{entity_id}:{o}", actor) for i, o in enumerate((operation, *then))]
        return self.spark.createDataFrame(events, TABLES["journal"])

    def _write(self, changes: dict[str, DataFrame], operation: str, kind: str, entity_id: str, actor: str) -> str:
        self.store.commit({**changes, "journal": self._event(operation, kind, entity_id, actor)})
        return entity_id

    def _one(self, outcome: mutations.Outcome) -> DataFrame:
        wrong = outcome.rejected.limit(1).collect()
        if wrong:
            raise MemoryError_(wrong[0]["error"])
        at = F.lit(self.clock())
        return outcome.accepted.withColumn("created_at", at).withColumn("updated_at", at)

    def aliases(self) -> DataFrame:
        """(alias, canonical) of every merged id; kept up to date merge by merge."""
        kept = self.store.manifest()["tables"]
        if kept.get("redirects") and not kept.get("closure"):
            return identity.closure(self.store.rows("redirects"))
        return self.store.rows("closure").drop("_seq")

    def resolve(self, object_id: str) -> str:
        kept = self.store.manifest()["tables"]
        if not kept.get("redirects"):
            return object_id
        if kept.get("closure"):
            found = self.store.rows("closure").where(F.col("alias") == object_id).collect()
        else:
            found = identity.closure(self.store.rows("redirects"), keep_cycles=True).where(F.col("alias") == object_id).collect()
        if found and found[0]["canonical"] is None:
            raise MemoryError_(f"Circular redirect detected: {object_id}")
        return found[0]["canonical"] if found else object_id

    def _rows(self, table: str, where) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.store.table(table).where(where).orderBy("_first_seq").drop("_seq", "_first_seq").collect()]

    # Objects, facts, contexts ----------------------------------------------------------------------------------

    def create_object(self, type: str, name: str, aliases: list[str] | None = None, sensitivity: str = "internal", tenant_id: str = "default", actor: str = "system") -> str:
        batch = self._row("ord INT; type STRING; name STRING; aliases ARRAY<STRING>; sensitivity STRING; tenant_id STRING", ord=0, type=type, name=name, aliases=aliases or [], sensitivity=sensitivity, tenant_id=tenant_id)
        done = self._one(mutations.create_objects(batch, self.store.table("objects")))
        return self._write({"objects": done}, "create", "object", done.first()["id"], actor)

    def create_evidence(self, id: str, content_hash: str = "", source_version_id: str | None = None, segment_ref: str | None = None, state: str = "available", tenant_id: str = "default") -> str:
        row = self._row(TABLES["evidence"].replace(", ", "; "), id=id, source_version_id=source_version_id, segment_ref=segment_ref, content_hash=content_hash, state=state, tenant_id=tenant_id, created_at=self.clock())
        return self._write({"evidence": row}, "create", "evidence", id, "system")

    def _fact(self, kind: str, table: str, batch: DataFrame, actor: str, columns: dict) -> str:
        out = mutations.create_facts(batch, kind, self.store.table("objects"), self.store.table("evidence"), self.aliases())
        done = self._one(out)
        temporal = F.struct(*[F.lit(columns.get(c)).cast("string").alias(c) for c in ("observed_at", "valid_from", "valid_to")])
        done = done.withColumn("temporal_state", temporal)
        key = done.first()["id"]
        entity = "claim" if kind == "claim" else "relationship"
        proof = mutations.insert_absent(mutations.provenance(done, entity).withColumn("at", F.lit(0)), self.store.rows("provenance"), "id", "at").withColumn("learned_at", F.lit(self.clock()))
        return self._write({table: done, "provenance": proof}, "create", entity, key, actor)

    def create_claim(self, subject_id: str, predicate: str, object_or_value, evidence_refs: list[str], confidence: float = 0.5, sensitivity: str = "internal", tenant_id: str = "default", actor: str = "system", **temporal) -> str:
        number = float(object_or_value) if isinstance(object_or_value, int | float) else None
        shown = number_text(object_or_value) if number is not None else object_or_value
        batch = self._row(
            "ord INT; subject_id STRING; predicate STRING; object_or_value STRING; value_num DOUBLE; evidence_refs ARRAY<STRING>; confidence DOUBLE; sensitivity STRING; tenant_id STRING",
            ord=0, subject_id=subject_id, predicate=predicate, object_or_value=shown, value_num=number, evidence_refs=evidence_refs, confidence=float(confidence), sensitivity=sensitivity, tenant_id=tenant_id,
        )
        return self._fact("claim", "claims", batch, actor, temporal)

    def create_relationship(self, source_object: str, relation_type: str, target_object: str, evidence_refs: list[str], confidence: float = 0.5, sensitivity: str = "internal", tenant_id: str = "default", actor: str = "system", **temporal) -> str:
        batch = self._row(
            "ord INT; source_object STRING; relation_type STRING; target_object STRING; evidence_refs ARRAY<STRING>; confidence DOUBLE; sensitivity STRING; tenant_id STRING",
            ord=0, source_object=source_object, relation_type=relation_type, target_object=target_object, evidence_refs=evidence_refs, confidence=float(confidence), sensitivity=sensitivity, tenant_id=tenant_id,
        )
        return self._fact("rel", "relationships", batch, actor, temporal)

    def create_context(self, type: str, name: str, purpose: str | None = None, sensitivity: str = "internal", tenant_id: str = "default", actor: str = "system") -> str:
        batch = self._row("ord INT; type STRING; name STRING; purpose STRING; sensitivity STRING; tenant_id STRING", ord=0, type=type, name=name, purpose=purpose, sensitivity=sensitivity, tenant_id=tenant_id)
        done = self._one(mutations.create_contexts(batch, self.store.table("contexts")))
        return self._write({"contexts": done}, "create", "context", done.first()["id"], actor)

    def add_membership(self, context_id: str, member_type: str, member_id: str, mode: str = "explicit", confidence: float = 0.5, tenant_id: str = "default", actor: str = "system") -> str:
        batch = self._row("ord INT; context_id STRING; member_type STRING; member_id STRING; mode STRING; confidence DOUBLE; tenant_id STRING", ord=0, context_id=context_id, member_type=member_type, member_id=member_id, mode=mode, confidence=confidence, tenant_id=tenant_id)
        done = self._one(mutations.add_memberships(batch, self.store.table("contexts"), self.store.table("objects"), self.aliases()))
        return self._write({"memberships": done.withColumn("valid_from", F.lit(self.clock().isoformat()))}, "add_membership", "membership", done.first()["id"], actor)

    def remove_membership(self, id: str, actor: str = "system") -> str:
        """Writes the journal; the row stays, and ``effective_memberships`` leaves it out."""
        self.store.get("memberships", id)
        return self._write({}, "remove_membership", "membership", id, actor)

    def effective_memberships(self) -> DataFrame:
        return mutations.effective_memberships(self.store.table("memberships"), self.store.rows("journal"))

    def create_gap(self, type: str, description: str, subject_id: str | None = None, evidence_refs: list[str] | None = None, sensitivity: str = "internal", tenant_id: str = "default", actor: str = "system") -> str:
        key = f"gap:{type}:{self.store.last_sequence() + 1}"
        row = self._row(
            "id STRING; type STRING; subject_id STRING; description STRING; evidence_refs ARRAY<STRING>; sensitivity STRING; tenant_id STRING; lifecycle_state STRING",
            id=key, type=type, subject_id=subject_id, description=description, evidence_refs=evidence_refs or [], sensitivity=sensitivity, tenant_id=tenant_id, lifecycle_state="open",
        ).withColumn("created_at", F.lit(self.clock()))
        return self._write({"gaps": row}, "create", "knowledge_gap", key, actor)

    def resolve_gap(self, id: str, actor: str = "system") -> str:
        batch = self._row("id STRING; at TIMESTAMP_NTZ", id=id, at=self.clock())
        out = mutations.resolve_gaps(batch, self.store.table("gaps").drop("_seq", "_first_seq"))
        wrong = out.rejected.collect()
        if wrong:
            raise MemoryError_(wrong[0]["error"])
        return self._write({"gaps": out.accepted}, "resolve", "knowledge_gap", id, actor)

    def merge(self, from_id: str, into_id: str, actor: str = "system") -> str:
        batch = self._row("ord INT; from_id STRING; into_id STRING", ord=0, from_id=from_id, into_id=into_id)
        objects = self.store.table("objects")
        edge = self._one(mutations.merge_objects(batch, objects, self.aliases())).first()
        moved = objects.where(F.col("id") == edge["from_id"]).withColumn("lifecycle_state", F.lit("merged")).withColumn("redirect_to", F.lit(edge["into_id"])).withColumn("updated_at", F.lit(self.clock())).drop("_seq", "_first_seq")
        redirect = self._row("from_id STRING; into_id STRING", from_id=edge["from_id"], into_id=edge["into_id"])
        # both ends are what they stand for already, so what led to the one now leads to the other
        led = F.when(F.col("canonical") == edge["from_id"], F.lit(edge["into_id"])).otherwise(F.col("canonical"))
        closure = self.aliases().select("alias", led.alias("canonical")).unionByName(redirect.select(F.col("from_id").alias("alias"), F.col("into_id").alias("canonical")))
        changes = {"objects": moved, "redirects": redirect, "closure": closure, "journal": self._event("merge", "object", edge["from_id"], actor)}
        self.store.commit(changes, replace=("closure",))
        return edge["from_id"]

    def mark_unavailable(self, evidence_id: str, actor: str = "system") -> str:
        out = mutations.mark_unavailable(self._row("id STRING", id=evidence_id), self.store.table("evidence").drop("_seq", "_first_seq"))
        wrong = out.rejected.collect()
        if wrong:
            raise MemoryError_(wrong[0]["error"])
        return self._write({"evidence": out.accepted}, "mark_unavailable", "evidence", evidence_id, actor)

    # Proposals -------------------------------------------------------------------------------------------------

    def propose(self, type: str, payload: dict, evidence_refs: list[str] | None = None, extractor: str = "manual", extractor_version: str = "1", actor: str = "system", tenant_id: str = "default") -> str:
        """A candidate; its evidence, if it names any, must be held and available. Candidates belong to no tenant."""
        refs = evidence_refs or []
        wrong = mutations.evidence_errors(self._row("k INT; refs ARRAY<STRING>", k=0, refs=refs), "k", "refs", self.store.table("evidence", where=F.col("id").isin(refs))).collect()
        if wrong:
            raise MemoryError_(wrong[0]["error"])
        key = f"cand:{type}:{self.store.last_sequence() + 1}"
        row = self.spark.createDataFrame([(key, type, json.dumps(payload), refs, extractor, extractor_version, self.clock())], TABLES["candidates"])
        return self._write({"candidates": row}, "propose", "candidate", key, actor)

    def decide(self, candidate_id: str, actor: str = "system") -> dict:
        """The verdict on a candidate, given once."""
        c = self.store.get("candidates", candidate_id)
        key = f"dec:{candidate_id}"
        if self.decisions_of(candidate_id):
            raise MemoryError_(f"Candidate already decided: {candidate_id}")
        batch = self._row("ord INT; id STRING; type STRING; payload STRING; evidence_refs ARRAY<STRING>", ord=0, id=candidate_id, type=c["type"], payload=c["payload"], evidence_refs=c["evidence_refs"])
        got = self.decision_model(batch, self.store.table("claims").count()).first()
        row = self.spark.createDataFrame([(key, candidate_id, got["verdict"], got["reasoning"], "deterministic", self.clock())], TABLES["decisions"])
        self._write({"decisions": row}, "decide", "decision", key, actor)
        return {"id": key, "verdict": got["verdict"], "reasoning": got["reasoning"]}

    def apply_policy(self, decision_id: str, actor: str = "system") -> dict:
        """What follows from a decision, given once; the memory itself is not changed by it."""
        d = self.store.get("decisions", decision_id)
        if self.policies_of(decision_id):
            raise MemoryError_(f"Decision already policy-applied: {decision_id}")
        got = self.policy_model(self._row("id STRING; verdict STRING; reasoning STRING", id=decision_id, verdict=d["verdict"], reasoning=d["reasoning"])).first().asDict()
        key = f"pol:{decision_id}"
        row = self.spark.createDataFrame([(key, decision_id, got["action"], got.get("acl_ref"), self.clock())], TABLES["policies"])
        self._write({"policies": row}, "apply_policy", "policy", key, actor)
        return {"id": key, "action": got["action"]}

    def decisions_of(self, candidate_id: str) -> list[dict]:
        return self._rows("decisions", F.col("candidate_ref") == candidate_id)

    def policies_of(self, decision_id: str) -> list[dict]:
        return self._rows("policies", F.col("decision_ref") == decision_id)

    def versions_of(self, item_id: str) -> list[dict]:
        return self._rows("source_versions", F.col("source_item_id") == item_id)

    def representations_of(self, evidence_id: str) -> list[dict]:
        return self._rows("representations", F.col("evidence_id") == evidence_id)

    # Texts -----------------------------------------------------------------------------------------------------

    def ingest(self, folder: str, source_name: str, trusted: bool = True, tenant_id: str = "default", actor: str = "system") -> dict:
        found = files.text_files(self.spark, folder)
        out = files.ingest(found, source_name, trusted, self.store.table("source_items"), self.store.table("source_versions"), self.store.table("evidence"), F.lit(self.clock()), tenant_id)
        report = out["report"].first().asDict()
        key = "source:" + "-".join(source_name.lower().split())
        changes = {"source_items": out["items"], "source_versions": out["versions"], "evidence": out["evidence"]}
        known = self.store.table("sources").where(F.col("id") == key).limit(1).count()
        if not known:
            changes["sources"] = self._row("id STRING; type STRING; name STRING; trust_profile STRING; state STRING; tenant_id STRING", id=key, type="filesystem", name=source_name, trust_profile="trusted" if trusted else "untrusted", state="active", tenant_id=tenant_id)
        self._write(changes, "ingest", "source", key, actor)
        return {"source_id": key, **report}

    def extract(self, evidence_id: str, content: str, actor: str = "system", tenant_id: str = "default", model=None) -> dict:
        """Facts of one text through proposal, decision and policy into the memory: a batch of one for ``extract_all``."""
        held = self.store.get("evidence", evidence_id)
        if held["state"] != "available":
            raise MemoryError_(f"Evidence unavailable (quarantined): {evidence_id}")
        texts = self._row("ord INT; evidence_id STRING; content STRING; tenant_id STRING", ord=0, evidence_id=evidence_id, content=content, tenant_id=tenant_id)
        got = self.extract_all(texts, actor, model).first()
        return {c: got[c] if got else 0 for c in ("candidates", "accepted", "quarantined", "rejected")}

    def extract_all(self, texts: DataFrame, actor: str = "system", model=None) -> DataFrame:
        """``texts`` (ord, evidence_id, content, tenant_id) taken in order, as one batch: counts per evidence of what
        became of the facts in them. Texts whose evidence isn't held and available give nothing.

        ``model``: a function of the texts giving claims and relationships shaped as ``extract_claims`` and
        ``extract_relationships`` do; the memory's own if not given.
        """
        available = self.store.table("evidence").where(F.col("state") == "available").select(F.col("id").alias("evidence_id"))
        admitted = texts.join(available, "evidence_id", "left_semi")
        claims, rels = (model or self.extraction_model)(admitted)
        name, version = ("async-extraction", "1.0.0-async") if model else ("regex-extraction", "1.0.0")
        out = extraction.extracted(
            admitted, claims, rels, self.store.table("objects"), self.aliases(), self.store.table("claims").count(), self.decision_model, self.policy_model, self.store.version() + 1
        )
        last = self.store.last_sequence()
        at = F.lit(self.clock())
        journal = mutations.journal_rows(out["events"].withColumn("actor", F.lit(actor)), ["ord", "step"], last, at)
        stamp = {t: out[t].withColumn("created_at", at).withColumn("updated_at", at) for t in ("objects", "claims", "relationships", "candidates", "decisions", "policies")}
        stamp["candidates"] = stamp["candidates"].withColumn("extractor", F.lit(name)).withColumn("extractor_version", F.lit(version))
        proof = mutations.insert_absent(out["provenance"].withColumn("at", F.lit(0)), self.store.rows("provenance"), "id", "at").withColumn("learned_at", at)
        self.store.commit({**stamp, "provenance": proof, "journal": journal}, order="ord")
        return out["counts"]

    def represent(self, evidence_id: str, content: str, kind: str = "essence_nl", actor: str = "system") -> str:
        self.store.get("evidence", evidence_id)
        texts = self._row("evidence_id STRING; content STRING", evidence_id=evidence_id, content=content)
        key = f"rep:{kind}:{self.store.last_sequence() + 1}"
        made = self.representation_model(texts.withColumnRenamed("content", "body"), "evidence_id", "body", kind)
        row = made.withColumn("id", F.lit(key)).withColumn("generator", F.lit("simple")).withColumn("generator_version", F.lit("1.0.0")).withColumn("content_hash", F.concat_ws(":", "evidence_id", "type")).withColumn("created_at", F.lit(self.clock()))
        return self._write({"representations": row}, "create", "representation", key, actor)

    def embed(self, evidence_id: str, content: str) -> list[float]:
        """A text's vector by the embedding model."""
        texts = self._row("evidence_id STRING; content STRING", evidence_id=evidence_id, content=content)
        made = retrieval.dense(self.embedding_model(texts, "evidence_id", "content"), "evidence_id").first()
        return list(made["embedding"]) if made else [0.0] * 64

    # Queries ---------------------------------------------------------------------------------------------------

    def get(self, table: str, id: str) -> dict:
        return self.store.get(table, self.resolve(id) if table == "objects" else id)

    def claims_of(self, object_id: str) -> list[dict]:
        return self._rows("claims", F.col("subject_id") == self.resolve(object_id))

    def relationships_of(self, object_id: str) -> list[dict]:
        """Out-edges, then in-edges; a self-loop comes twice."""
        at = self.resolve(object_id)
        return self._rows("relationships", F.col("source_object") == at) + self._rows("relationships", F.col("target_object") == at)

    def provenance_of(self, assertion_id: str) -> list[dict]:
        return self._rows("provenance", F.col("assertion_id") == assertion_id)

    def entry_points(self, query: str, kind: str = "essence_nl") -> DataFrame:
        return retrieval.entry_points(self.store.table("representations").where(F.col("type") == kind), "id", query, "_first_seq")

    def knowledge(self, query: str, tenant_id: str = "default") -> dict[str, DataFrame]:
        claims = retrieval.matching_claims(self.store.table("claims").where(access.in_tenant(tenant_id)), query)
        rels = retrieval.matching_relationships(self.store.table("relationships").where(access.in_tenant(tenant_id)), query)
        return {"claims": claims, "relationships": rels, "objects": retrieval.mentioned_objects(claims, rels, self.store.table("objects"))}

    def _edges(self, tenant_id: str | None = None) -> DataFrame:
        """By every id that stands for their source; an edge written again keeps its place."""
        return graph.stepping(graph.edges(self.store.rows("relationships"), tenant_id, "_seq"), self.aliases())

    def traverse(self, start: str, depth: int = 3, ordered: bool = True, tenant_id: str | None = None) -> DataFrame:
        """Paths of every tenant's edges, merges followed at each step; those all of whose edges are a tenant's, if named."""
        starts = self._row("id STRING", id=start)
        found = self._edges(None if ordered else tenant_id)
        walked = graph.ordered_walk(found, starts, depth) if ordered else graph.simple_paths(found, starts, depth)
        return graph.within_tenant(walked, tenant_id) if tenant_id is not None and ordered else walked

    def context_of(self, start: str, depth: int = 3, tenant_id: str = "default") -> dict:
        at = self.resolve(start)
        ours = access.in_tenant(tenant_id)
        return {
            "paths": [r.asDict() for r in self.traverse(at, depth, tenant_id=tenant_id).orderBy("rank").collect()],
            "claims": self._rows("claims", (F.col("subject_id") == at) & ours),
            "objects": self._rows("objects", (F.col("id") == at) & ours),
            "gaps": self._rows("gaps", (F.col("subject_id") == at) & ours),
        }

    def paths(self, start: str, end: str, depth: int = 4, tenant_id: str = "default") -> DataFrame:
        """Multi-hop paths, best first, in the order of the depth-first walk where equal; nodes as the edges record them."""
        a, b = self.resolve(start), self.resolve(end)
        if a == b:
            return self.spark.createDataFrame([([a], [], 1.0)], "nodes array<string>, edge_ids array<string>, score double")
        found = graph.standing_for(self._edges(tenant_id), self.aliases(), b)
        walk = graph.ordered_walk(found, self._row("id STRING", id=a), depth, b)
        return walk.orderBy(F.col("score").desc(), "rank").select("nodes", "edge_ids", "score")

    def agent_context(self, context_id: str, most: str | None = None, tenant_id: str = "default", agent_id: str | None = None, purpose: str | None = None) -> dict | None:
        """What an agent may see of a context; None where the context is unknown or the agent may not see it."""
        context = self.store.table("contexts").where(F.col("id") == context_id)
        gate = self.gate(context, most).limit(1).collect()
        if not gate or not gate[0]["allowed"]:
            return None
        if agent_id:
            asked = self._row("agent_id STRING; tenant_id STRING; sensitivity STRING; purpose STRING", agent_id=agent_id, tenant_id=tenant_id, sensitivity=gate[0]["sensitivity"], purpose=purpose)
            policies = self.store.rows("agent_policies").withColumnRenamed("_seq", "ord")
            if not self.agent_gate(asked, policies).first()["allowed"]:
                return None
        members = self.store.table("memberships").where(F.col("context_id") == context_id)
        names = {"object": "objects", "claim": "claims", "relationship": "relationships", "evidence": "evidence", "knowledge_gap": "gaps"}
        tables = {k: self.store.table(t) for k, t in names.items()}
        seen = retrieval.agent_members(members, tables, self.aliases(), tenant_id, access.within(F.col("sensitivity"), most)).collect()
        out: dict = {}
        for kind, t in names.items():
            ids = [r["member_id"] for r in seen if r["member_type"] == kind]
            rows = {r["id"]: r for r in self._rows(t, F.col("id").isin(ids))} if ids else {}
            out["known_gaps" if t == "gaps" else t] = [rows[i] for i in ids]
        return out

    def set_agent_policy(self, agent_id: str, tenant_id: str, max_sensitivity: str, allowed_purposes: list[str] | None = None) -> None:
        self.store.commit({"agent_policies": self._row("agent_id STRING; tenant_id STRING; max_sensitivity STRING; allowed_purposes ARRAY<STRING>", agent_id=agent_id, tenant_id=tenant_id, max_sensitivity=max_sensitivity, allowed_purposes=allowed_purposes)})

    # Segments, journal -----------------------------------------------------------------------------------------

    def export_segment(self, context_id: str, purpose: str = "", expires_in_days: int | None = None, actor: str = "system", sensitivity: str | None = None) -> str:
        context = self.store.table("contexts").where(F.col("id") == context_id)
        if context.limit(1).count() == 0:
            raise MemoryError_(f"Context not found: {context_id}")
        key = f"seg:{context_id}:{self.store.last_sequence() + 1}"
        held = self.store.table("memberships").where(F.col("context_id") == context_id)
        rows = segments.with_lists(segments.export_segments(context, held, expires_in_days, F.lit(self.clock()), self.sign), segments.members(held)).withColumn("id", F.lit(key)).withColumn("purpose", F.lit(purpose)).withColumn("created_at", F.lit(self.clock()))
        rows = rows if sensitivity is None else rows.withColumn("sensitivity", F.lit(sensitivity))
        return self._write({"segments": rows}, "export", "segment", key, actor)

    def import_segment(self, segment: DataFrame | dict | str, apply: bool = False, actor: str = "system") -> dict:
        """Checks a segment (held under an id, a row, or its fields) and, with ``apply``, that its members are held."""
        if isinstance(segment, dict):
            fields = self.spark.createDataFrame([], TABLES["segments"]).schema
            segment = self.spark.read.schema(fields).json(self.spark.sparkContext.parallelize([json.dumps({f.name: segment.get(f.name) for f in fields})]))
            segment = segment.select(*[F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) if f.name.startswith("included_") else F.col(f.name) for f in fields])
        rows = self.store.table("segments").where(F.col("id") == segment) if isinstance(segment, str) else segment
        held = {"object": self.store.table("objects"), "claim": self.store.table("claims"), "relationship": self.store.table("relationships"), "evidence": self.store.table("evidence")}
        got = segments.check_import(rows, segments.from_lists(rows), held, F.lit(self.clock()), apply, self.verify).first()
        if got is None:
            raise KeyError("segment not found")
        if got["error"]:
            raise MemoryError_(got["error"])
        steps = ("import_verified", "import_applied") if got["applied"] else ("import_verified",) if got["verified"] else ("import_rejected",)
        self.store.commit({"journal": self._event(steps[0], "segment", got["id"] if "id" in got else got["root_context"], actor, *steps[1:])})
        return {"verified": got["verified"], "applied": got["applied"]}

    def journal(self, since: int = 0) -> list[dict]:
        return [r.asDict() for r in self.store.rows("journal").where(F.col("sequence") > since).orderBy("sequence").drop("_seq").collect()]
