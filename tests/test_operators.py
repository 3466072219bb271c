"""Single operators on small inputs: edge cases, order, ties."""

import math
import random
import time

from pyspark.sql import functions as F

from mnemora.functions import text
from mnemora.operators import access, extraction, graph, identity, mutations, retrieval
from mnemora.operators.sequence import lagged, numbered
from mnemora.session import cut, partitions
from mnemora.sources.files import classify, evidence_of


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    assert one(spark, text.tokens(F.col("t")), t="PostgreSQL caused_by a База 42x") == ["postgre", "sql", "caused", "база", "42x"]
    assert one(spark, text.embedding_tokens(F.col("t")), t="PostgreSQL") == ["postgresql"]
    assert one(spark, text.slug(F.col("t")), t="A  b\tC") == "a-b-c"
    assert one(spark, text.first_quarter(F.col("t")), t="a b c d e f g h i") == "a b" and one(spark, text.first_quarter(F.col("t")), t="a") == "a"
    assert one(spark, text.sensitivity(F.col("t")), t="odd") == "internal" and one(spark, text.sensitivity(F.col("t")), t=None) == "internal"
    assert one(spark, text.clamp(F.col("x")), x=1.5) == 1 and one(spark, text.clamp(F.col("x")), x=math.nan) == 0
    assert text.query_tokens("PostgreSQL database of it") == ["postgre", "sql", "database"]


def test_bucket_matches_a_wrapped_32_bit_hash(spark):
    def brute(t):
        h = 0
        for c in t:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return abs(h) % 64

    words = ["postgresql", "детерминированное", "zzzzzzzzzzzzzzzzzzzz", "a1b2"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(text.bucket(F.col("t"), 64)).collect()
    assert [r[0] for r in got] == [brute(w) for w in words]


def test_cosine(spark):
    def cos(a, b):
        return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(text.cosine(F.col("a"), F.col("b"))).first()[0]

    assert abs(cos([1.0, 2.0], [1.0, 2.0]) - 1) < 1e-12 and cos([1.0, 0.0], [0.0, 1.0]) == 0 and cos([1.0], [-1.0]) == -1
    assert cos([0.0, 0.0], [1.0, 1.0]) == 0 and cos([1.0, 5.0], [2.0]) == 1


def test_hash_embeddings(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "k long, t string")
    sparse = retrieval.hash_embeddings(df, "k", "t")
    dense = {r["k"]: r["embedding"] for r in retrieval.dense(sparse, "k").collect()}
    assert list(dense) == [1] and abs(sum(x * x for x in dense[1]) - 1) < 1e-9 and len(dense[1]) == 64


def test_extraction_caps(spark):
    t = ". ".join(f"we chose thing{i}" for i in range(15)) + ". Sky is blue. Grass is green. Bob has role boss."
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "Nothing here\r\nX caused by Y\rZ depends on W")], "k long, t string")
    got = extraction.extract_claims(df, "k", "t").collect()
    assert [sum(r["pattern_no"] == i for r in got if r["k"] == 1) for i in range(3)] == [10, 1, 1]  # each gives one at the cap
    rels = {(r["relation_type"], r["source_name"], r["target_name"]) for r in extraction.extract_relationships(df, "k", "t").collect()}
    assert rels == {("caused_by", "X", "Y"), ("depends_on", "Z", "W")}


def test_patterns_begin_where_they_always_did(spark):
    odd = ["", "is", " is ", "are", "has role", "\n", ".", ".\n", ",", "-", "7", "_", "\t", "é", "ж", "\u2028", "A", "Foo bar", "we chose ", " as ", " supersedes ", "\ncaused by ", " depends  on ", " contradicts "]
    dice = random.Random(3)
    df = spark.createDataFrame([("".join(dice.choices(odd, k=i % 40)),) for i in range(4_000)], "t string")
    for p, at in [*zip(extraction.CLAIM_PATTERNS, extraction._AT, strict=True), *((p, extraction._LINE) for p in extraction.RELATION_PATTERNS.values())]:
        kept = F.transform(extraction._matches(F.col("t"), p, "", at), lambda m: m["basis"])
        plain = F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(0)), lambda m: F.concat(F.lit("Pattern match: "), F.substring(m, 1, 50)))
        n = df.select(kept.alias("a"), plain.alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("differ"), F.sum(F.size("a")).alias("found")).first()
        assert n["differ"] == 0 and n["found"] > 100


def test_extraction_goes_through_a_long_line_once(spark):
    long = "we go on " * 30_000
    df = spark.createDataFrame([(1, f"{long}, sky is blue.\nX caused by Y.\n{long}(a) Bob has role boss.")], "k long, t string")
    began = time.time()
    claims = {(r["subject_name"], r["object_or_value"]) for r in extraction.extract_claims(df, "k", "t").collect()}
    rels = {(r["relation_type"], r["source_name"], r["target_name"]) for r in extraction.extract_relationships(df, "k", "t").collect()}
    assert claims == {("sky", "blue"), ("Bob", "boss")} and rels == {("caused_by", "X", "Y")}
    assert time.time() - began < 60  # each letter of the line used to be a start from which the rest of it was read


def test_ranges_go_by_what_is_read(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "concat('text ', id) AS t").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    joined = rows.join(rows.withColumnRenamed("t", "u"), "id")
    assert partitions(joined) == partitions(cut(joined).where("id >= 0")) == 4
    assert 4 < partitions(rows, 100_000) < 50  # a large input is still cut further
    ranged = numbered(joined, ["id"], "n")
    assert ranged.rdd.getNumPartitions() <= 4 and ranged.agg(F.max("n")).first()[0] == 100_000


def test_model_answers(spark):
    inner = '{"claims":[{"subjectName":" A ","predicate":"has_role","objectOrValue":"x","confidence":0.4},{"subjectName":"","predicate":"has_role"},{"subjectName":"B","predicate":"odd"}],"relationships":[{"sourceName":"A","relationType":"supersedes","targetName":"B","confidence":1.5},{"sourceName":"A","relationType":"odd","targetName":"B"}]}'
    import json

    bodies = [json.dumps({"response": inner}), "no json", json.dumps({"error": "busy"}), "{}", json.dumps({"response": "no json"}), None]
    df = spark.createDataFrame(list(enumerate(bodies)), "k long, body string")
    got = {(r["k"], r["kind"]): r for r in extraction.parse_answers(df, "k", "body").collect()}
    assert got[0, "claim"]["a"] == "A" and got[0, "relationship"]["confidence"] == 1.0
    assert [got[i, "error"]["error"] for i in range(1, 6)] == ["invalid JSON response", "busy", "response has no generated text", "model returned invalid JSON", "invalid JSON response"]
    choices = spark.createDataFrame([(1, json.dumps({"choices": [{"message": {"content": inner}}]}))], "k long, body string")
    assert extraction.parse_answers(choices, "k", "body", "choices").count() == 2


def test_decisions(spark):
    df = spark.createDataFrame([(1, "ClaimCandidate", []), (2, "ClaimCandidate", ["a", "b"]), (3, "ClaimCandidate", ["a"]), (4, "RelationshipCandidate", ["a"]), (5, "ClaimCandidate", None)], "ord int, type string, evidence_refs array<string>")
    got = {r["ord"]: (r["verdict"], r["action"]) for r in extraction.decide(df).collect()}
    assert got == {1: ("Reject", "Deny"), 2: ("Accept", "Allow"), 3: ("Escalate", "Quarantine"), 4: ("Accept", "Allow"), 5: ("Reject", "Deny")}
    assert {r["verdict"] for r in extraction.decide(df.where("ord = 3"), 0).collect()} == {"Accept"}
    assert {r["verdict"] for r in extraction.decide(df.where("ord = 3"), 1).collect()} == {"Escalate"}
    assert extraction.decide(df.where("false")).count() == 0


REL = "row_seq long, id string, source_object string, relation_type string, target_object string, lifecycle_state string, confidence double, tenant_id string"


def edges(spark, pairs):
    return graph.edges(spark.createDataFrame([(i, f"r{i}", a, "x", b, "active", 0.5, "t") for i, (a, b) in enumerate(pairs)], REL))


def test_walks_differ_where_a_node_is_met_twice(spark):
    e = edges(spark, [("a", "b"), ("b", "d"), ("d", "e"), ("a", "c"), ("c", "d"), ("z", "z")])
    start = spark.createDataFrame([("a",)], "id string")
    ordered = ["".join(r["nodes"]) for r in graph.ordered_walk(e, start, 4).orderBy("rank").collect()]
    assert ordered == ["ab", "abd", "abde", "ac", "acd"]
    assert {"".join(r["nodes"]) for r in graph.simple_paths(e, start, 4).collect()} == {*ordered, "acde"}
    loop = spark.createDataFrame([("z",)], "id string")
    assert graph.ordered_walk(e, loop, 3).count() == 1 and graph.simple_paths(e, loop, 3).count() == 0
    assert [r["hops"] for r in graph.paths_between(e, "a", "d", 3).collect()] == [2, 2]
    superseded = spark.createDataFrame([(1, "r", "a", "x", "b", "superseded", 0.5, "t"), (2, None, "a", "x", "b", "active", None, "t"), (3, "q", None, "x", "b", "active", None, "t")], REL)
    assert graph.edges(superseded).count() == 0


def test_closure(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "a"), ("q", None)], "from_id string, into_id string")
    assert {tuple(r) for r in identity.closure(df).collect()} == {("a", "c"), ("b", "c")}
    assert {r["id"] for r in identity.cyclic(df).collect()} == {"x", "y", "s"}
    facts = spark.createDataFrame([("a", 1), ("other", 2), (None, 3)], "subject_id string, n int")
    assert {tuple(r) for r in identity.resolve(facts, "subject_id", identity.closure(df)).collect()} == {("c", 1), ("other", 2), (None, 3)}


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = numbered(df, ["x"], "n", 5).orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(5, 1005)) and [r["x"] for r in got] == list(range(1000))
    assert numbered(df.where("false"), ["x"], "n").count() == 0


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m[7] = m[3]
    m[9] = 0
    data = [(i, [float(x) for x in m[i]]) for i in range(60)] + [(100, None)]
    df = spark.createDataFrame(data, "vec_id long, v array<double>")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    for block in (4, 2048):
        got = retrieval.nearest(df, df.where("vec_id % 10 = 3 OR vec_id = 9"), "vec_id", "v", 5, block)
        for q in (3, 13, 9):
            want = sorted((-float(u[q] @ u[j]), j) for j in range(60) if j != q)[:5]
            mine = [(r["vec_id"], r["similarity"]) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()]
            assert np.allclose([-w for w, _ in want], [s for _, s in mine])
    assert retrieval.nearest(df.where("false"), df.where("false"), "vec_id", "v").count() == 0


def test_upsert_policies(spark):
    df = spark.createDataFrame([("k", 2, "b", 2.0), ("k", 1, "a", 1.0), ("k", 3, None, None)], "key string, o int, v string, c double")
    assert tuple(mutations.latest(df, "key", "o", ["v", "c"]).first()) == ("k", None, None, 3)
    assert tuple(mutations.first_kept(df, "key", "o", ["v"], ["c"]).first()) == ("k", "a", None, 3)
    assert mutations.insert_absent(df, df.where("false"), "key", "o").first()["v"] == "a"
    assert mutations.insert_absent(df, df, "key", "o").count() == 0


def test_agent_gate(spark):
    policies = spark.createDataFrame([("a", "t", 2, "public", None), ("a", "t", 1, "internal", ["audit"])], "agent_id string, tenant_id string, ord int, max_sensitivity string, allowed_purposes array<string>")
    asked = spark.createDataFrame([("a", "t", "internal", "audit"), ("a", "t", "restricted", "audit"), ("a", "t", "public", "sales"), ("a", "t", "public", None), ("b", "t", "public", None)], "agent_id string, tenant_id string, sensitivity string, purpose string")
    got = {tuple(r)[:4]: r["allowed"] for r in access.agent_gate(asked, policies).select("agent_id", "tenant_id", "sensitivity", "purpose", "allowed").collect()}
    assert got == {("a", "t", "internal", "audit"): True, ("a", "t", "restricted", "audit"): False, ("a", "t", "public", "sales"): False, ("a", "t", "public", None): True, ("b", "t", "public", None): False}


def test_arrivals(spark):
    df = spark.createDataFrame([("s", "a.md", "h1", 1), ("s", "a.md", "h1", 2), ("s", "a.md", "h2", 3), ("s", None, "h", 4), ("s", None, "h", 5)], "source_id string, external_id string, content_hash string, o int")
    assert [r["status"] for r in classify(df, ["o"]).orderBy("o").collect()] == ["new", "unchanged", "changed", "new", "new"]
    texts = spark.createDataFrame([("x", False), ("x", True), ("y", False), (None, True)], "t string, ok boolean")
    assert sorted(r["state"] for r in evidence_of(texts, "t", F.col("ok")).collect()) == ["available", "unavailable"]


def test_evidence_errors_in_order(spark):
    ev = spark.createDataFrame([("e1", "available"), ("e2", "unavailable")], "id string, state string")
    df = spark.createDataFrame([(1, ["e1"]), (2, ["e1", "e2", "e9"]), (3, ["e9", "e2"]), (4, None), (5, [None])], "k int, refs array<string>")
    assert {r["k"]: r["error"] for r in mutations.evidence_errors(df, "k", "refs", ev).collect()} == {2: "Evidence unavailable (quarantined): e2", 3: "Unknown evidence: e9"}


def test_merges_in_one_batch(spark):
    objects = spark.createDataFrame([("a", "active"), ("b", "active"), ("m", "merged")], "id string, lifecycle_state string")
    none = spark.createDataFrame([], "alias string, canonical string")
    batch = spark.createDataFrame([(1, "a", "b"), (2, "a", "m"), (3, "m", "b"), (4, "b", "b"), (5, "z", "b"), (6, "b", "z")], "ord int, from_id string, into_id string")
    out = mutations.merge_objects(batch, objects, none)
    assert [r["ord"] for r in out.accepted.collect()] == [1] and {r["ord"] for r in out.rejected.collect()} == {2, 3, 4, 5, 6}


def test_asking_models(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "k long, t string")

    def client(t):
        if t == "bad":
            raise OSError("down")
        return '{"embedding": [1.0, 2.0]}'

    got = {r["k"]: r for r in extraction.parse_embeddings(extraction.ask_model(df, "k", "t", client), "k", "body").collect()}
    assert got[1]["embedding"] == [1.0, 2.0] and got[1]["dimensions"] == 2 and got[2]["error"] and 3 not in got
    shapes = spark.createDataFrame([(1, '{"embeddings": [[3.0]]}'), (2, '{"embedding": "x"}'), (3, "{"), (4, '{"embeddings": []}'), (5, None)], "k long, body string")
    got = {r["k"]: r["embedding"] for r in extraction.parse_embeddings(shapes, "k", "body").collect()}
    assert got == {1: [3.0], 2: None, 3: None, 4: None, 5: None}


def test_lag_across_partitions(spark):
    df = spark.range(2000).select(F.lit("hot").alias("g"), (F.col("id") * 3).alias("o"), (F.col("id") * 10).alias("v")).union(spark.createDataFrame([("cold", 5, 1)], "g string, o long, v long"))
    got = {(r["g"], r["o"]): r["b"] for r in lagged(df, ["g"], ["o"], "v", "b").collect()}
    assert len(got) == 2001 and got["cold", 5] is None and got["hot", 0] is None and all(got["hot", 3 * i] == 10 * (i - 1) for i in range(1, 2000))
    assert lagged(df.where("false"), ["g"], ["o"], "v", "b").count() == 0
