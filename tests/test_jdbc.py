"""Tables in a relational database and back; Derby comes with Spark."""

from datetime import datetime

from mnemora.schema import TABLES
from mnemora.sources import jdbc
from mnemora.sources.store import Store


def test_round_trip(spark, tmp_path):
    url, t = f"jdbc:derby:{tmp_path}/db;create=true", datetime(2025, 1, 1)
    rows = spark.createDataFrame([("obj:a", "t", "A", ["x", None], "active", None, "public", "default", t, t), ("obj:b", None, None, None, None, None, None, None, None, None), ("obj:c", "t", "", [], "active", "obj:a", "public", "other", t, t)], TABLES["objects"])
    jdbc.write_table(rows, url, "objects")
    back = jdbc.read_table(spark, url, "objects")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"objects": back})
    assert store.get("objects", "obj:a")["aliases"] == ["x", None]
    jdbc.write_table(store.table("objects"), url, "objects", "copied", createTableColumnTypes="id VARCHAR(400)")
    assert jdbc.read_table(spark, url, "objects", "copied").where("id = 'obj:c'").first()["redirect_to"] == "obj:a"


def test_parallel_ranges_and_journal(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"event:{i}", "2025", "object", f"obj:{i}", "create", "h", "a") for i in range(1, 101)], TABLES["journal"])
    jdbc.write_table(rows, url, "journal", parts=2)
    back = jdbc.read_table(spark, url, "journal", split="sequence", bounds=(1, 101), parts=4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 100 and back.where("sequence > 90").count() == 10


def test_upsert_edges(spark):
    schema = "id string, value string, lifecycle_state string, tenant_id string"
    stored = spark.createDataFrame([("a", "1", "active", "t"), ("b", None, "active", "t")], schema)
    changes = spark.createDataFrame([("a", "2", "retired", "u", 1), ("a", "3", None, "v", 2), ("c", "4", "x", None, 1), (None, "5", "x", "t", 1), ("b", "6", "y", "t", 1)], f"{schema}, row_seq int")
    got = sorted(tuple(r) for r in jdbc.upserted(stored, changes, ("lifecycle_state",), "row_seq").collect())
    assert got == [("a", "1", None, "v"), ("b", None, "y", "t"), ("c", "4", "x", None)]
    assert jdbc.upserted(stored.where("false"), changes.where("false"), (), "row_seq").count() == 0
    odd = spark.createDataFrame([("x", "{no json", "0.5")], "ID string, evidence_refs string, confidence string")
    r = jdbc.decoded(odd, "claims").first()
    assert r["id"] == "x" and r["evidence_refs"] is None and r["confidence"] == 0.5
