"""Queries do the whole job: paths in full depth, feeds cut by their own length."""

import itertools

import __spark_entry__ as entry
from mnemora.operators import graph
from mnemora.plans.memory import END, START


def test_paths_of_four_edges_of_the_tenant_through_redirects(spark, tmp_path):
    objects = [(x, r, "active", "t", x, "public", "default", "2025-01-01", "2025-01-01") for x, r in ((START, None), (END, None), *((c, None) for c in "bcdf"), ("old-c", "c"))]
    spark.createDataFrame(objects, "id string, redirect_to string, lifecycle_state string, type string, name string, sensitivity string, tenant_id string, created_at string, updated_at string").write.parquet(str(tmp_path / "objects.parquet"))
    pairs = [(START, "b", "default"), ("b", "old-c", "default"), ("c", "d", "default"), ("d", END, "default"), (START, "f", "other"), ("f", END, "default"), ("c", "b", "default")]
    rels = [(i, f"r{i}", s, t, "rel", "active", 0.5, tenant) for i, (s, t, tenant) in enumerate(pairs)]
    spark.createDataFrame(rels, "row_seq long, id string, source_object string, target_object string, relation_type string, lifecycle_state string, confidence double, tenant_id string").write.parquet(str(tmp_path / "relationships.parquet"))
    got = [tuple(r) for r in entry.queries()["multi_hop_paths_whole"](spark, str(tmp_path)).collect()]
    assert got == [(f"{START}>b>c>d>{END}", "r0|r1|r2|r3", 4, 0.0625)]


def test_dropping_hopeless_paths_loses_none(spark):
    pairs = [(a, b) for a, b in itertools.permutations("abcdefg", 2) if (ord(a) * 7 + ord(b) * 3) % 5 < 2]
    rows = [(f"{a}{b}", a, b, "rel", 0.9, i) for i, (a, b) in enumerate(pairs)]
    found = spark.createDataFrame(rows, "edge_id string, source string, target string, relation string, confidence double, ord int")
    want = {("a", *mid, "g") for n in range(4) for mid in itertools.permutations("bcdef", n) if all(p in pairs for p in itertools.pairwise(("a", *mid, "g")))}
    got = graph.paths_between(found, "a", "g", 4).collect()
    assert len(want) == 3 and max(map(len, want)) == 5
    assert {tuple(r["nodes"]) for r in got} == want and len(got) == len(want)


def test_journal_is_cut_by_its_own_length(spark, tmp_path):
    rows = [(i, f"e{i}", "object", f"obj:{i}") for i in range(1, 101)] + [(90, "e3", "object", "obj:3"), (95, "e70", "object", "obj:70")]
    spark.createDataFrame(rows, "sequence long, id string, entity_type string, entity_id string").write.parquet(str(tmp_path / "journal.parquet"))
    got = sorted((r["sequence"], r["id"]) for r in entry.queries()["journal_apply"](spark, str(tmp_path)).collect())
    assert got == [(i, f"e{i}") for i in range(51, 101)]


def test_created_claims_come_as_rows(spark):
    rows = entry.queries()["claim_create_rows"](spark, "/root/testdata/sf0.001")
    counts = {r["reason"]: r["n"] for r in entry.queries()["claim_create"](spark, "/root/testdata/sf0.001").collect()}
    got = rows.collect()
    assert len(got) == sum(counts.values()) and sum(r["error"] == "" for r in got) == counts["accepted"]
    assert all(r["id"].startswith(f"claim:{r['subject_id']}:") and r["evidence_count"] > 0 for r in got if r["error"] == "")
