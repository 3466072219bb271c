"""The general data problems against brute force, and their edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemora.operators import changefeed, hierarchy, intervals, references
from mnemora.schema import TABLES

CLAIM = "row_seq BIGINT, subject_id STRING, valid_from STRING, valid_to STRING, evidence_refs ARRAY<STRING>, created_at TIMESTAMP_NTZ, lifecycle_state STRING"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def claims(spark, data):
    return spark.createDataFrame([(i, s, a, b, None, None, None) for i, (s, a, b) in enumerate(data)], CLAIM)


def found(spark, data):
    return rows(intervals.periods_and_gaps(intervals.claim_intervals(claims(spark, data))))


def brute_periods(data):
    out, by = set(), {}
    for s, a, b in data:
        if a < b:
            by.setdefault(s, []).append((a, b))
    for s, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(s, "period", a, b) for a, b in merged}
        out |= {(s, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_intervals_equal_brute_force(spark, seed):
    r = random.Random(seed)
    base = datetime(2020, 1, 1)
    data = []
    for _ in range(400):
        a = r.randrange(0, 3000)
        data.append((r.choice("aaaab") + str(r.randrange(0, 3)), a, a + r.randrange(-5, 40)))
    at = lambda n: (base + timedelta(hours=n)).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert found(spark, [(s, at(a), at(b)) for s, a, b in data]) == sorted((s, k, at(a), at(b)) for s, k, a, b in brute_periods(data))


def test_interval_forms(spark):
    got = found(spark, [
        ("a", "2020-01-01", "2020-02-01T00:00:00+02:00"), ("a", "2020-01-31T22:00:00", "2020-03-01T00:00:00.000Z"), ("a", "2020-01-05", "2020-01-06"),
        ("a", "2020-05-01T10:00:00-0500", "9999-12-31"), ("a", "2021-01-01", "2022-01-01"), ("b", "2020-02-30", None), ("b", "2020-13-01", None), ("b", "soon", None),
        ("b", None, None), ("b", "", None), ("b", "2020-01-01", ""), ("b", "2020-01-01", "2020-01-01"), ("b", "2020-01-01", "2019-01-01"), (None, "2020-01-01", None),
        ("", "2020-01-01", None), ("c", "2020-06-01T00:00:00,5z", None), ("d", "2020-01-01 05:00", "2020-01-01T06"), ("e", " 2020-01-01", None), ("f", "2020", None),
    ])
    assert got == [
        ("a", "gap", "2020-03-01T00:00:00Z", "2020-05-01T15:00:00Z"), ("a", "period", "2020-01-01T00:00:00Z", "2020-03-01T00:00:00Z"),
        ("a", "period", "2020-05-01T15:00:00Z", "open"), ("c", "period", "2020-06-01T00:00:00Z", "open"),
    ]


def test_intervals_empty_and_time_zone(spark):
    assert found(spark, []) == []
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert found(spark, [("a", "2020-01-01", "2020-01-02")]) == [("a", "period", "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_one_hot_subject_spans_partitions(spark):
    at = lambda n: (datetime(2020, 1, 1) + timedelta(minutes=n)).strftime("%Y-%m-%dT%H:%M:%SZ")
    data = [("hot", at(i), at(i + 2)) for i in range(3000)] + [("hot", at(5000), at(5001))]
    assert found(spark, data) == [("hot", "gap", at(3001), at(5000)), ("hot", "period", at(0), at(3001)), ("hot", "period", at(5000), at(5001))]


def test_extra_columns_with_clashing_names(spark):
    df = claims(spark, [("a", "2020-01-01", None)]).withColumn("key", F.lit(1)).withColumn("s", F.lit("x")).withColumn("pid", F.lit(3)).withColumn("e", F.lit(0))
    assert rows(intervals.periods_and_gaps(intervals.claim_intervals(df))) == [("a", "period", "2020-01-01T00:00:00Z", "open")]


# References --------------------------------------------------------------------------------------------------------

T = [datetime(2022, m, 1) for m in range(1, 13)]


def ref_tables(spark, c, r, o, e):
    return (
        spark.createDataFrame([(i, s, None, None, ev, at, None) for i, (s, ev, at) in enumerate(c)], CLAIM),
        spark.createDataFrame([(i, a, b, at) for i, (a, b, at) in enumerate(r)], "row_seq BIGINT, source_object STRING, target_object STRING, created_at TIMESTAMP_NTZ"),
        spark.createDataFrame(o, "id STRING, lifecycle_state STRING, updated_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"),
        spark.createDataFrame(e, "id STRING, state STRING, created_at TIMESTAMP_NTZ"),
    )


def test_references(spark):
    o = [("a", "active", T[0], T[0]), ("a", "active", T[1], T[0]), ("r", "active", T[0], T[0]), ("r", "retired", T[3], T[0]), ("back", "retired", T[0], T[0]), ("back", "active", T[5], T[0]), ("new", "merged", T[6], T[6])]
    e = [("e1", "available", T[0]), ("e1", "available", T[0]), ("e2", "unavailable", T[0]), ("e3", None, T[8])]
    c = [("a", ["e1", "e1", "e2", None, ""], T[2]), ("nobody", ["e9", "e9"], T[2]), (None, None, T[2]), ("", [], T[2]), ("new", ["e3"], T[4]), ("new", ["e3"], T[9]), (" ", None, None)]
    r = [("r", "back", T[2]), ("r", None, T[3]), ("gone", "gone", T[3])]
    got = rows(references.failing_of(*ref_tables(spark, c, r, o, e)))
    assert got == sorted([
        ("claims", "evidence_refs", 0, "e2", "deleted", "2022-03"), ("claims", "subject_id", 1, "nobody", "missing", "2022-03"), ("claims", "evidence_refs", 1, "e9", "missing", "2022-03"),
        ("claims", "subject_id", 4, "new", "late", "2022-05"), ("claims", "evidence_refs", 4, "e3", "late", "2022-05"), ("claims", "subject_id", 6, " ", "missing", "unknown"),
        ("relationships", "source_object", 0, "r", "deleted", "2022-03"), ("relationships", "source_object", 1, "r", "deleted", "2022-04"),
        ("relationships", "source_object", 2, "gone", "missing", "2022-04"), ("relationships", "target_object", 2, "gone", "missing", "2022-04"),
    ])


def test_references_empty_tables(spark):
    assert rows(references.failing_of(*ref_tables(spark, [], [], [], []))) == []
    got = references.failing_of(*ref_tables(spark, [("a", ["e"], T[0])], [], [], []))
    assert {r["kind"] for r in got.collect()} == {"missing"}
    assert rows(references.failure_counts(got)) == [("claims", "evidence_refs", "missing", "2022-01", 1, 1), ("claims", "subject_id", "missing", "2022-01", 1, 1)]


# Hierarchies -------------------------------------------------------------------------------------------------------


def brute_hierarchy(nxt, ids):
    out = []
    for start in ids:
        if not nxt.get(start):
            continue
        path, at = [start], start
        while nxt.get(at) and nxt[at] in ids and nxt[at] not in path:
            at = nxt[at]
            path.append(at)
        if nxt.get(at) and nxt[at] in path:
            first = path.index(nxt[at])
            ring = path[first:]
            out.append((start, min(ring), first, "", "into_cycle" if first else "cycle"))
        else:
            out.append((start, at, len(path) - 1, ">".join(reversed(path)), "broken" if nxt.get(at) else "tree"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_equals_brute_force(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(120)]
    nxt = {i: r.choice([None, "", "nowhere", *ids, *ids[:3], *ids[:3]]) for i in ids}
    nxt |= {f"n{i}": f"n{i + 1}" for i in range(60, 110)}
    df = spark.createDataFrame([(i, nxt[i], T[0]) for i in ids for _ in range(2)], "id STRING, redirect_to STRING, updated_at TIMESTAMP_NTZ")
    assert rows(hierarchy.object_hierarchy(df)) == brute_hierarchy(nxt, set(ids))


def test_hierarchy_edges(spark):
    schema = "id STRING, redirect_to STRING, updated_at TIMESTAMP_NTZ"
    assert rows(hierarchy.object_hierarchy(spark.createDataFrame([], schema))) == []
    df = spark.createDataFrame([("a", "a", T[0]), ("b", None, T[2]), ("b", "a", T[1]), (None, "a", T[0]), ("c", " ", T[0]), ("d", "c", T[0])], schema)
    got = hierarchy.object_hierarchy(df)
    assert rows(got) == [("a", "a", 0, "", "cycle"), ("c", "c", 0, "c", "broken"), ("d", "c", 1, "c>d", "broken")]
    assert rows(hierarchy.descendants(got)) == [("c", "d", 1)]


def test_hierarchy_of_hot_targets_and_long_rings(spark, monkeypatch):
    """Half the nodes lead to one; a ring longer than what leads into it, its smallest id far from the entry."""
    monkeypatch.setattr(hierarchy._look_up, "__defaults__", (5, 4))
    ids = [f"n{i:03}" for i in range(160)]
    nxt = {i: "n000" if k < 80 else None for k, i in enumerate(ids)} | {"n000": None, "n001": "n002"}
    ring, tail = ids[90:121], ids[121:160]
    nxt |= {a: b for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)} | {a: b for a, b in zip(tail, [*tail[1:], ring[7]], strict=True)}
    nxt["n085"] = "n086"
    nxt["n086"] = "gone"
    df = spark.createDataFrame([(i, nxt[i], T[0]) for i in ids], "id STRING, redirect_to STRING, updated_at TIMESTAMP_NTZ")
    assert rows(hierarchy.object_hierarchy(df)) == brute_hierarchy(nxt, set(ids))


# Change feeds ------------------------------------------------------------------------------------------------------


def brute_feed(data):
    first = {}
    for seq, i, kind, ent, op in data:
        if seq is None or ent is None:
            continue
        key = i if i is not None else ("row", seq, ent, op)
        if key not in first or (seq, kind, ent) < first[key][:3]:
            first[key] = (seq, kind, ent, op)
    state = {}
    for seq, kind, ent, op in sorted(first.values(), key=lambda x: x[0]):
        op = (op or "").strip().lower()
        if op in changefeed.CREATES or (op in changefeed.CHANGES and (kind, ent) in state):
            state[kind, ent] = seq
        elif op in changefeed.REMOVES:
            state.pop((kind, ent), None)
    return sorted((k, e, s) for (k, e), s in state.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_feed_equals_brute_force(spark, seed):
    r = random.Random(seed)
    ops = ["create", "Create ", "update", "UPDATE", "merge", "delete", "\tdelete", "remove_membership", "add_membership", "decide", None, "resolve"]
    data = []
    for seq in range(600):
        data.append((seq, f"c{seq}", r.choice("ab"), f"x{r.choice([0, 0, 0, r.randrange(40)])}", r.choice(ops)))
    again = [(x[0] + r.choice([0, 0, 50, 300]), *x[1:]) for x in r.sample(data, 80)]
    used = {x[0] for x in data}
    again = [x if x[0] not in used else (x[0] + 1000, *x[1:]) for x in again]
    data += again
    r.shuffle(data)
    df = spark.createDataFrame(data, "sequence BIGINT, id STRING, entity_type STRING, entity_id STRING, operation STRING")
    assert rows(changefeed.current_state(df)) == brute_feed(data)


def test_feed_edges(spark):
    schema = "sequence BIGINT, id STRING, entity_type STRING, entity_id STRING, operation STRING, effect STRING, rank INT"
    assert rows(changefeed.current_state(spark.createDataFrame([], schema))) == []
    data = [(None, "a", "t", "x", "create", "z", 1), (1, None, "t", "x", "create", "z", 1), (2, None, "t", "x", "update", "z", 1), (3, "b", "t", None, "create", "z", 1), (4, "c", "t", "y", "update", "z", 1)]
    df = spark.createDataFrame(data, schema)
    assert rows(changefeed.current_state(df)) == [("t", "x", 2)]
    base = spark.createDataFrame([("t", "y", 0)], "entity_type STRING, entity_id STRING, sequence BIGINT")
    assert rows(changefeed.current_state(df, base)) == [("t", "x", 2), ("t", "y", 4)]


def test_schemas_parse(spark):
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).schema.names
