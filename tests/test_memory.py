"""The memory one call at a time: what it accepts, refuses and finds."""

import io
import json
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemora.operators import extraction
from mnemora.memory import Memory, MemoryError_, number_text
from mnemora.server import answer, main, tool, tools_over_stdio
from mnemora.sources.store import Conflict, place
from mnemora.streaming import replication


class Clock:
    now = datetime(2025, 1, 1)

    def __call__(self):
        return self.now


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "store"), Clock())


@pytest.fixture(scope="module")
def template(spark, tmp_path_factory):
    """The filled store, built once; tests work on copies."""
    folder = tmp_path_factory.mktemp("template") / "store"
    memory = Memory(spark, str(folder), Clock())
    for i in (1, 2, 3):
        memory.create_evidence(f"ev:e{i}", f"h{i}")
    memory.create_object("technology", "PostgreSQL")
    memory.create_object("incident", "Migration Failure")
    memory.create_object("decision", "Switch to CockroachDB")
    memory.create_claim("obj:postgresql", "has_role", "PrimaryDatabase", ["ev:e1"], valid_from="2022-01-01")
    memory.create_claim("obj:migration-failure", "has_property", "caused_outage", ["ev:e2"])
    memory.create_relationship("obj:switch-to-cockroachdb", "supersedes", "obj:postgresql", ["ev:e3"])
    memory.create_relationship("obj:migration-failure", "caused_by", "obj:switch-to-cockroachdb", ["ev:e2"])
    return folder


@pytest.fixture
def filled(spark, template, tmp_path):
    shutil.copytree(template, tmp_path / "filled")
    return Memory(spark, str(tmp_path / "filled"), Clock())


def test_objects_once_and_journal_gapless(memory):
    assert memory.create_object("x", "My  Thing") == "obj:my-thing"
    with pytest.raises(MemoryError_, match="M4 violated"):
        memory.create_object("y", "my thing")
    memory.create_object("", "")
    assert [e["sequence"] for e in memory.journal()] == [1, 2]
    assert memory.journal(1)[0]["operation"] == "create"
    with pytest.raises(KeyError):
        memory.get("objects", "obj:none")


def test_claims_need_evidence_and_subject(filled):
    with pytest.raises(MemoryError_, match="Unknown evidence: ev:no"):
        filled.create_claim("obj:postgresql", "has_role", "x", ["ev:no"])
    with pytest.raises(MemoryError_, match="M1 violated"):
        filled.create_claim("obj:postgresql", "has_role", "x", [])
    with pytest.raises(MemoryError_, match="Subject object not found: obj:gone"):
        filled.create_claim("obj:gone", "has_role", "x", ["ev:e1"])
    filled.mark_unavailable("ev:e1")
    with pytest.raises(MemoryError_, match="quarantined"):
        filled.create_claim("obj:postgresql", "has_role", "x", ["ev:e1"])
    assert filled.claims_of("obj:postgresql")[0]["object_or_value"] == "PrimaryDatabase"  # what it supported stays
    assert filled.provenance_of("claim:obj:postgresql:has_role")[0]["evidence_id"] == "ev:e1"
    with pytest.raises(MemoryError_, match="Evidence not found"):
        filled.mark_unavailable("ev:none")


def test_upserts(filled):
    filled.create_claim("obj:postgresql", "has_role", "Replica", ["ev:e2"], 0.9)
    assert [c["object_or_value"] for c in filled.claims_of("obj:postgresql")] == ["Replica"]
    kept = filled.store.table("claims", by_column=True).where(F.col("subject_id") == "obj:postgresql").first()
    assert (kept["object_or_value"], kept["confidence"]) == ("PrimaryDatabase", 0.9)
    filled.create_claim("obj:postgresql", "has_value", 99.9, ["ev:e2"])
    assert filled.get("claims", "claim:obj:postgresql:has_value")["value_num"] == 99.9


def test_merge_and_redirect(filled):
    filled.create_object("technology", "Postgres")
    filled.merge("obj:postgres", "obj:postgresql")
    assert filled.resolve("obj:postgres") == "obj:postgresql"
    assert filled.get("objects", "obj:postgres")["id"] == "obj:postgresql"
    for a, b, text in (("obj:postgres", "obj:postgresql", "self-merge"), ("obj:none", "obj:postgresql", "source not found"), ("obj:postgresql", "obj:none", "target not found")):
        with pytest.raises(MemoryError_, match=text):
            filled.merge(a, b)
    filled.create_claim("obj:postgres", "has_property", "x", ["ev:e1"])
    assert {c["predicate"] for c in filled.claims_of("obj:postgres")} == {"has_role", "has_property"}
    assert filled.create_object("technology", "Postgres") == "obj:postgres"  # a merged name may be used again


def test_traversal(filled):
    hops = [len(r["edge_ids"]) for r in filled.traverse("obj:migration-failure").orderBy("rank").collect()]
    assert hops == [1, 2]
    best = filled.paths("obj:migration-failure", "obj:postgresql").collect()
    assert [(len(r["edge_ids"]), r["score"]) for r in best] == [(2, 0.25)]
    assert filled.paths("obj:postgresql", "obj:postgresql").first()["score"] == 1
    assert filled.paths("obj:postgresql", "obj:migration-failure").count() == 0
    got = filled.context_of("obj:migration-failure")
    assert len(got["paths"]) == 2 and len(got["claims"]) == 1 and got["objects"][0]["name"] == "Migration Failure" and got["gaps"] == []
    assert filled.context_of("obj:migration-failure", tenant_id="other") == {"paths": [], "claims": [], "objects": [], "gaps": []}
    filled.create_relationship("obj:postgresql", "related_to", "obj:postgresql", ["ev:e1"])
    assert len(filled.relationships_of("obj:postgresql")) == 3  # in, and a self-loop twice


@pytest.fixture
def merged(spark, tmp_path):
    """a-b, c-d, b-e; then b is merged into c."""
    m = Memory(spark, str(tmp_path / "merged"), Clock())
    m.create_evidence("ev:x")
    for n in "abcde":
        m.create_object("t", n)
    m.create_relationship("obj:a", "related_to", "obj:b", ["ev:x"], 0.5)
    m.create_relationship("obj:c", "related_to", "obj:d", ["ev:x"], 0.5)
    m.create_relationship("obj:b", "related_to", "obj:e", ["ev:x"], 0.5)
    m.merge("obj:b", "obj:c")
    return m


def test_walks_follow_merges_at_each_step_and_keep_recorded_ids(merged):
    nodes = [r["nodes"] for r in merged.traverse("obj:a").orderBy("rank").collect()]
    assert nodes == [["obj:a", "obj:b"], ["obj:a", "obj:b", "obj:d"]]
    assert [r["nodes"] for r in merged.paths("obj:a", "obj:d").collect()] == [["obj:a", "obj:b", "obj:d"]]
    assert merged.paths("obj:a", "obj:e").count() == 0  # recorded under the merged id: merging does not rewrite facts
    assert [r["nodes"] for r in merged.paths("obj:a", "obj:c").collect()] == [["obj:a", "obj:b"]]
    assert merged.resolve("obj:b") == "obj:c" and merged.context_of("obj:b")["paths"][0]["nodes"] == ["obj:c", "obj:d"]
    merged.merge("obj:c", "obj:a")
    assert merged.resolve("obj:b") == "obj:a" == merged.resolve("obj:c")


def test_a_foreign_edge_still_visits_what_it_leads_to(filled):
    filled.create_object("t", "q")
    filled.create_relationship("obj:migration-failure", "related_to", "obj:postgresql", ["ev:e1"], tenant_id="other")
    filled.create_relationship("obj:postgresql", "related_to", "obj:q", ["ev:e1"])
    got = [r["nodes"] for r in filled.context_of("obj:migration-failure")["paths"]]
    assert ["obj:migration-failure", "obj:switch-to-cockroachdb", "obj:postgresql", "obj:q"] in got
    filled.create_relationship("obj:migration-failure", "caused_by", "obj:switch-to-cockroachdb", ["ev:e2"], 0.9)  # keeps its place
    assert filled.traverse("obj:migration-failure").orderBy("rank").first()["nodes"][1] == "obj:switch-to-cockroachdb"


def test_numbers_are_written_whole(filled):
    for x, text in ((1234567, "1234567"), (99.9, "99.9"), (3.0, "3"), (1e21, "1e+21"), (1e-7, "1e-7"), (-0.1234567891, "-0.1234567891"), (123456789012345680000.0, "123456789012345680000")):
        assert number_text(x) == text
    filled.create_claim("obj:postgresql", "has_value", 1234567, ["ev:e1"])
    assert filled.get("claims", "claim:obj:postgresql:has_value")["object_or_value"] == "1234567"


def test_compaction_changes_nothing_that_can_be_asked(filled):
    filled.create_claim("obj:postgresql", "has_role", "Replica", ["ev:e2"], 0.9)
    filled.create_claim("obj:postgresql", "has_role", "Third", ["ev:e2"], 0.7)
    seen = lambda: [sorted(map(str, filled.store.table(t, by_column=c).drop("_seq", "_first_seq").collect())) for t in ("claims", "objects", "journal", "provenance") for c in (False, True)]
    before, last = seen(), filled.store.last_sequence()
    for t in ("claims", "objects", "journal", "provenance"):
        filled.store.compact(t)
    assert seen() == before and filled.store.last_sequence() == last
    assert filled.store.table("claims", by_column=True).where(F.col("subject_id") == "obj:postgresql").first()["object_or_value"] == "PrimaryDatabase"


def test_places_beyond_any_number_of_partitions(spark):
    at = [(1 << 62) + 5, (70_000 << 33) + (1 << 30), 0]
    df = spark.createDataFrame([(i,) for i in at], "at LONG")
    got = [int(r[0]) for r in df.select(place(1, F.col("at"))).collect()]
    assert got == [(1 << 64) + i for i in at] and max(got) < int(df.select(place(2, F.lit(0))).first()[0])


def test_entry_points_and_keywords(filled):
    filled.represent("ev:e1", "PostgreSQL was chosen as primary database")
    filled.represent("ev:e2", "migration caused outage in june")
    got = filled.entry_points("PostgreSQL database").collect()
    assert [(round(r["score"], 2), r["matched"]) for r in got] == [(0.67, "postgre, sql")]
    filled.represent("ev:e3", "a database of PostgreSQL kind indeed here", "summary")
    for e in ("ev:e2", "ev:e1"):
        filled.represent(e, "postgresql", "embedding")
    assert [r["id"] for r in filled.entry_points("postgresql", "embedding").collect()] == [f"rep:embedding:{filled.store.last_sequence() - 1}", f"rep:embedding:{filled.store.last_sequence()}"]
    found = filled.knowledge("what supersedes the primary caused outage")
    assert found["relationships"].count() == 1 and found["claims"].count() == 2 and found["objects"].count() == 3
    assert filled.knowledge("caused_by")["relationships"].count() == 0  # a type with _ never matches
    assert filled.knowledge("supersedes", "other")["relationships"].count() == 0


def test_contexts_and_agents(filled):
    ctx = filled.create_context("review", "Database Review")
    with pytest.raises(MemoryError_, match="exists"):
        filled.create_context("review", "Database Review")
    with pytest.raises(MemoryError_, match="Context not found"):
        filled.add_membership("ctx:none", "object", "obj:postgresql")
    with pytest.raises(MemoryError_, match="Object not found"):
        filled.add_membership(ctx, "object", "obj:none")
    member = filled.add_membership(ctx, "object", "obj:postgresql")
    filled.create_object("technology", "Secret", sensitivity="restricted")
    filled.add_membership(ctx, "object", "obj:secret")
    filled.add_membership(ctx, "evidence", "ev:e1")
    filled.add_membership(ctx, "claim", "claim:obj:postgresql:has_role")
    gap = filled.create_gap("OpenQuestion", "why", "obj:postgresql")
    filled.add_membership(ctx, "knowledge_gap", gap)
    seen = filled.agent_context(ctx, "internal")
    assert [o["id"] for o in seen["objects"]] == ["obj:postgresql"] and len(seen["known_gaps"]) == 1 and len(seen["evidence"]) == 1 and len(seen["claims"]) == 1
    assert {o["id"] for o in filled.agent_context(ctx)["objects"]} == {"obj:postgresql", "obj:secret"}  # no limit given
    assert filled.agent_context("ctx:none") is None and filled.agent_context(ctx, "public") is None
    assert filled.agent_context(ctx, agent_id="bot") is None
    filled.set_agent_policy("bot", "default", "internal", ["audit"])
    assert filled.agent_context(ctx, agent_id="bot", purpose="sales") is None
    assert filled.agent_context(ctx, agent_id="bot", purpose="audit") is not None
    filled.remove_membership(member)
    assert filled.store.table("memberships").where(F.col("id") == member).count() == 1
    assert filled.effective_memberships().where(F.col("id") == member).count() == 0
    filled.resolve_gap(gap)
    assert filled.get("gaps", gap)["lifecycle_state"] == "resolved"
    with pytest.raises(MemoryError_, match="Gap not found"):
        filled.resolve_gap("gap:none")


def test_segments(filled):
    ctx = filled.create_context("review", "R")
    filled.add_membership(ctx, "object", "obj:postgresql")
    seg = filled.export_segment(ctx)
    assert filled.get("segments", seg)["payload_hash"] == "ctx:r:1:0"
    assert filled.import_segment(seg, apply=True) == {"verified": True, "applied": True}
    assert [e["operation"] for e in filled.journal(filled.store.last_sequence() - 2)] == ["import_verified", "import_applied"]
    assert filled.import_segment(seg) == {"verified": True, "applied": False}
    held = filled.store.table("segments").where(F.col("id") == seg)
    assert filled.import_segment(held.withColumn("payload_hash", F.lit("x"))) == {"verified": False, "applied": False}
    with pytest.raises(MemoryError_, match="object not found locally: obj:no"):
        filled.import_segment(held.withColumn("included_objects", F.array(F.lit("obj:no"))), apply=True)
    old = filled.export_segment(ctx, expires_in_days=-1)
    with pytest.raises(MemoryError_, match="expired"):
        filled.import_segment(old)
    assert filled.get("segments", filled.export_segment(ctx, expires_in_days=0))["expires_at"] is None


@pytest.mark.parametrize(
    ("refs", "kind", "verdict", "action"),
    [(["ev:e1", "ev:e2"], "ClaimCandidate", "Accept", "Allow"), ([], "ClaimCandidate", "Reject", "Deny"), (["ev:e1"], "ClaimCandidate", "Escalate", "Quarantine"), (["ev:e1"], "RelationshipCandidate", "Accept", "Allow")],
)
def test_proposals(filled, refs, kind, verdict, action):
    c = filled.propose(kind, {"x": 1}, refs)
    d = filled.decide(c)
    assert d["verdict"] == verdict
    assert filled.apply_policy(d["id"])["action"] == action
    with pytest.raises(MemoryError_, match="already decided"):
        filled.decide(c)
    with pytest.raises(MemoryError_, match="already policy-applied"):
        filled.apply_policy(d["id"])
    with pytest.raises(MemoryError_, match="Unknown evidence"):
        filled.propose(kind, {}, ["ev:none"])
    with pytest.raises(KeyError):
        filled.decide("cand:none")


def test_extraction(memory):
    text = "We chose PostgreSQL as primary store.\nThe outage caused by bad config.\nADR-2 supersedes ADR-1."
    memory.create_evidence("ev:a")
    got = memory.extract("ev:a", text)
    assert got == {"candidates": got["candidates"], "accepted": got["accepted"], "quarantined": got["quarantined"], "rejected": 0}
    assert got["candidates"] == got["accepted"] + got["quarantined"] and got["accepted"] >= 3
    again = memory.extract("ev:a", "We selected Redis as cache.")
    assert again["quarantined"] == 1 and again["accepted"] == 0
    assert memory.extract("ev:a", "") == {"candidates": 0, "accepted": 0, "quarantined": 0, "rejected": 0}
    memory.mark_unavailable("ev:a")
    with pytest.raises(MemoryError_):
        memory.extract("ev:a", text)
    with pytest.raises(KeyError):
        memory.extract("ev:none", text)


def test_ingest(memory, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    for name, body in (("adr-001.md", "one"), ("adr-002.MD", "two"), ("sub/notes.txt", "three"), ("image.png", "x")):
        (folder / name).write_text(body)
    got = memory.ingest(str(folder), "My Docs")
    assert (got["source_id"], got["items_ingested"], got["versions_created"], got["evidence_created"], got["skipped"]) == ("source:my-docs", 3, 3, 3, 0)
    assert memory.ingest(str(folder), "My Docs")["skipped"] == 3
    (folder / "adr-001.md").write_text("one changed")
    (folder / "new.rst").write_text("four")
    got = memory.ingest(str(folder), "My Docs")
    assert (got["versions_created"], got["evidence_created"], got["skipped"]) == (2, 2, 2)
    assert memory.store.table("source_items").count() == 4 and memory.store.table("source_versions").count() == 5
    (folder / "bad.md").write_text("five")
    assert memory.ingest(str(folder), "My Docs", trusted=False)["quarantined"] == 1
    assert sum(e["operation"] == "ingest" for e in memory.journal()) == 4


def test_versions_and_conflicts(spark, memory, tmp_path):
    memory.create_object("a", "A")
    v = memory.store.version()
    memory.create_object("b", "B")
    assert memory.store.table("objects", v).count() == 1 and memory.store.table("objects").count() == 2
    with pytest.raises(Conflict):
        memory.store._publish(v, {"batch": "x"})
    memory.store.export_json("objects", str(tmp_path / "json"))
    memory.store.compact("objects")
    assert memory.store.table("objects").count() == 2 and memory.store.table("objects", v).count() == 1
    other = Memory(spark, str(tmp_path / "copy"))
    other.store.import_json("objects", str(tmp_path / "json"))
    assert other.get("objects", "obj:a")["aliases"] == []


def test_replication(spark, memory, tmp_path):
    memory.create_object("a", "A")
    memory.create_object("b", "B")
    other = Memory(spark, str(tmp_path / "other"))
    fetch = lambda since: memory.store.rows("journal").where(F.col("sequence") > since)
    assert replication.pull_loop(other.store, fetch, 2) == {"rounds": 2, "applied": 2, "last_sequence": 2}
    assert replication.apply_events(other.store, memory.store.rows("journal")) == 0
    third = Memory(spark, str(tmp_path / "third"))
    feed = str(tmp_path / "feed")
    events = memory.store.rows("journal").drop("_seq")
    for _ in range(2):
        events.unionByName(events).write.mode("append").parquet(feed)
        replication.replicate_stream(spark, feed, third.store, str(tmp_path / "cp")).awaitTermination(60)
        assert third.store.rows("journal").count() == 2
    assert third.store.last_sequence() == 2


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("text")
    (tmp_path / "in" / "b.bin").write_text("text")
    seen = []
    replication.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "c"), lambda df: seen.extend(df.collect())).awaitTermination(60)
    assert [r["external_id"] for r in seen] == ["a.md"]


def test_http_tools_and_commands(filled, capsys):
    assert answer(filled, "GET", "/health")[0] == 200
    assert answer(filled, "POST", "/objects", {"type": "t", "name": "New One", "tenantId": "default"}) == (200, {"id": "obj:new-one"})
    assert answer(filled, "POST", "/objects", {"type": "t", "name": "New One"})[0] == 400
    assert answer(filled, "GET", "/objects/obj:postgresql")[1]["name"] == "PostgreSQL"
    assert answer(filled, "GET", "/objects/obj:none")[0] == 404 and answer(filled, "GET", "/nothing")[0] == 404
    assert answer(filled, "GET", "/contexts/ctx:none/agent-context")[0] == 404
    assert len(answer(filled, "POST", "/query/multi-hop", {"start": "obj:migration-failure", "end": "obj:postgresql"})[1]) == 1
    assert answer(filled, "GET", "/replication/events?since=3", token="t")[0] == 401
    assert answer(filled, "GET", "/replication/events?since=3", token="t", given="Bearer t")[1]["events"][0]["sequence"] == 4
    assert answer(filled, "POST", "/replication/events", {"events": [{"id": "event:far", "sequence": 99, "operation": "create"}]})[1] == {"applied": 1}
    assert tool(filled, "memory_get_object", {"id": "obj:postgresql"})["name"] == "PostgreSQL"
    assert tool(filled, "memory_query_context", {"startObjectId": "obj:migration-failure", "maxDepth": 1})["claims"]
    with pytest.raises(ValueError, match="id is missing"):
        tool(filled, "memory_get_claim", {})
    out = io.StringIO()
    tools_over_stdio(filled, ['{"id": 1, "method": "tools/list"}', '{"id": 2, "method": "tools/call", "params": {"name": "none"}}'], out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert len(first["result"]["tools"]) == 9 and first["result"]["tools"][0]["inputSchema"]["required"] == ["id"] and "error" in second
    assert len(main(["journal", "--since", "1"], filled)) == len(filled.journal(1))




def test_request_bodies(filled):
    post = lambda url, **body: answer(filled, "POST", url, body)
    status, got = post("/query/context", startObjectId="obj:migration-failure", maxDepth=1, tenantId="default")
    assert status == 200 and len(got["paths"]) == 1 and len(got["claims"]) == 1
    assert len(post("/query/multi-hop", startObjectId="obj:migration-failure", endObjectId="obj:postgresql", maxDepth=4)[1]) == 1
    assert post("/query/multi-hop", startObjectId="obj:migration-failure")[0] == 400
    status, got = post("/candidates", type="ClaimCandidate", payload={"x": 1}, evidenceRefs=["ev:e1"], extractor="hand", extractorVersion="2", actor="http", tenantId="default")
    assert status == 200 and filled.get("candidates", got["id"])["extractor"] == "hand"
    assert post("/extract", evidenceId="ev:e1", content="A is b.", **{"async": True})[0] == 400
    filled.slow_model = extraction.by_patterns
    status, got = post("/extract", evidenceId="ev:e1", content="Redis caused by disk.", tenantId="default", **{"async": True})
    assert status == 200 and got["candidatesCreated"] == 1 == got["accepted"]
    assert filled.store.table("candidates").where("extractor = 'async-extraction'").count() == 1
    post("/contexts", type="t", name="C")
    post("/contexts/ctx:c/memberships", memberType="object", memberId="obj:postgresql")
    status, segment = post("/segments/export", rootContext="ctx:c", purpose="p", sensitivity="public", expiresInDays=3)
    assert status == 200 and segment["sensitivity"] == "public" and segment["included_objects"] == ["obj:postgresql"]
    sent = json.loads(json.dumps(segment, default=str))
    assert post("/segments/import", segment=sent, autoApply=True)[1] == {"verified": True, "applied": True}
    assert post("/segments/import", segment={**sent, "signature": "no"})[1] == {"verified": False, "applied": False}
    assert post("/segments/import", segment=sent)[1] == {"verified": True, "applied": False}


def test_models_can_be_swapped(spark, template, tmp_path):
    shutil.copytree(template, tmp_path / "swapped")
    m = Memory(
        spark, str(tmp_path / "swapped"), Clock(), decide=lambda c, held: c.withColumn("verdict", F.lit("Reject")).withColumn("reasoning", F.lit("never")), policy=lambda d: d.withColumn("action", F.lit("Deny")),
        represent=lambda t, key, text, kind: t.select(key, F.lit(kind).alias("type"), F.upper(text).alias("content"), F.lit(1).alias("token_count"), F.array(F.lit("x")).alias("semantic_classes")),
        embed=lambda t, key, text: t.select(key, F.lit(3).alias("bucket"), F.lit(1.0).alias("weight")), agent_gate=lambda asked, policies: asked.withColumn("allowed", F.lit(True)),
        sign=lambda h: F.concat(F.lit("mine:"), h), verify=lambda s: F.col("signature") == F.concat(F.lit("mine:"), "payload_hash"), extract=lambda t: (extraction.extract_claims(t.withColumn("content", F.lit("Alpha is beta.")), "evidence_id", "content"), extraction.extract_relationships(t, "evidence_id", "content")),
    )
    d = m.decide(m.propose("RelationshipCandidate", {}, ["ev:e1", "ev:e2"]))
    assert (d["verdict"], d["reasoning"], m.apply_policy(d["id"])["action"]) == ("Reject", "never", "Deny")
    assert m.extract("ev:e1", "nothing here") == {"candidates": 1, "accepted": 0, "quarantined": 0, "rejected": 1}
    assert m.get("representations", m.represent("ev:e1", "abc"))["content"] == "ABC" and m.representations_of("ev:e1")
    assert m.embed("ev:e1", "abc")[3] == 1.0
    ctx = m.create_context("t", "C")
    assert m.agent_context(ctx, agent_id="unknown") is not None
    seg = m.export_segment(ctx)
    assert m.get("segments", seg)["signature"].startswith("mine:") and m.import_segment(seg)["verified"]


def test_extraction_of_many_texts_is_one_batch(spark, memory):
    for e in ("ev:a", "ev:b", "ev:c"):
        memory.create_evidence(e)
    memory.mark_unavailable("ev:c")
    memory.create_object("t", "Redis")
    texts = [(1, "ev:a", "Redis is cache.\nDisk has role store.", "t1"), (0, "ev:b", "Redis caused by Disk.\ndisk depends on Kafka.", "t2"), (2, "ev:c", "X is y.", "t1"), (3, "ev:none", "X is y.", "t1"), (4, "ev:a", None, "t1")]
    version, last = memory.store.version(), memory.store.last_sequence()
    got = {r["evidence_id"]: (r["candidates"], r["accepted"], r["quarantined"]) for r in memory.extract_all(spark.createDataFrame(texts, "ord INT, evidence_id STRING, content STRING, tenant_id STRING")).collect()}
    assert memory.store.version() == version + 1
    assert got["ev:b"] == (2, 2, 0) and got["ev:a"][0] == got["ev:a"][1] + got["ev:a"][2] and got["ev:a"][1] == 1 and set(got) == {"ev:a", "ev:b"}
    objects = {r["id"]: r for r in memory.store.table("objects").collect()}
    assert set(objects) == {"obj:redis", "obj:disk", "obj:kafka"} and objects["obj:disk"]["name"] == "Disk" and objects["obj:disk"]["tenant_id"] == "t2"
    assert {r["id"] for r in memory.store.table("relationships").collect()} == {"rel:obj:redis:caused_by:obj:disk", "rel:obj:disk:depends_on:obj:kafka"}
    new = memory.journal(last)
    assert [e["sequence"] for e in new] == list(range(last + 1, last + 1 + len(new)))
    assert [e["operation"] + " " + e["entity_type"] for e in new][:5] == ["propose candidate", "decide decision", "apply_policy policy", "create object", "create relationship"]
    assert memory.store.table("candidates").where(F.col("payload").contains("Pattern match: Redis caused by Disk.")).count() == 1
