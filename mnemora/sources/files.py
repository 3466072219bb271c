"""Reading folders of texts and ingesting them by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.text import content_id, slug
from mnemora.operators.sequence import lagged
from mnemora.session import cut

# The endings of text files.
ENDINGS = ("md", "txt", "markdown", "rst")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, external_id, content) of every text file under ``folder``, by its ending in any letter case."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return raw.where(ending.isin(*ENDINGS)).select("path", F.element_at(F.split("path", "/"), -1).alias("external_id"), F.decode("content", "UTF-8").alias("content"))


def evidence_of(texts: DataFrame, content: str, trusted: Column) -> DataFrame:
    """(id, content_hash, state, copies): one piece of evidence a content; that of untrusted sources is unavailable.

    Texts are content-addressed: repeated ones are one piece, with the state of a trusted copy if there is any. Null
    texts are none.
    """
    rows = texts.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("content_hash"), trusted.alias("t"))
    one = rows.groupBy("content_hash").agg(F.max("t").alias("t"), F.count("*").alias("copies"))
    return one.select(F.concat(F.lit("ev:"), F.substring("content_hash", 1, 12)).alias("id"), "content_hash", F.when(F.col("t"), F.lit("available")).otherwise(F.lit("unavailable")).alias("state"), "copies")


def classify(arriving: DataFrame, order: list[str]) -> DataFrame:
    """``arriving`` (source_id, external_id, content_hash, …) with ``status``: ``new`` item, ``changed`` or ``unchanged``.

    A text is compared with the one before it, in ``order``, of the same item. Items without an external id are told
    apart by nothing and count as new.
    """
    named = lagged(arriving.where(F.col("external_id").isNotNull()), ["source_id", "external_id"], order, "content_hash", "before")
    status = F.when(F.col("before").isNull(), F.lit("new")).when(F.col("before") == F.col("content_hash"), F.lit("unchanged")).otherwise(F.lit("changed"))
    nameless = arriving.where(F.col("external_id").isNull()).withColumn("status", F.lit("new"))
    return named.withColumn("status", status).drop("before").unionByName(nameless)


def ingest(files: DataFrame, source_name: str, trusted: bool, items: DataFrame, versions: DataFrame, evidence: DataFrame, at: Column, tenant: str = "default") -> dict[str, DataFrame]:
    """What a folder's files add: ``items`` (new or repointed), ``versions``, ``evidence`` and the ``report`` of counts.

    An item is a file name within its source; of several files of one name the last path counts as the newest. The
    same content as the item's current version is skipped; a version or piece of evidence known already is not added
    again, and keeps its first state.
    """
    source = F.concat(F.lit("source:"), slug(F.lit(source_name)))
    base = files.select("path", "external_id", "content", F.sha2("content", 256).alias("content_hash"), content_id("sv", F.col("content")).alias("version_id"), source.alias("source_id"))
    base = base.withColumn("item_id", F.concat(F.lit("item:"), "source_id", F.lit(":"), "external_id"))
    now = items.select(F.col("id").alias("item_id"), F.col("current_version_id").alias("held"))
    looked = lagged(base.drop("content"), ["item_id"], ["path"], "version_id", "last")
    judged = cut(looked.join(now, "item_id", "left").withColumn("before", F.coalesce("last", "held")))
    status = F.when(F.col("before").isNull(), F.lit("new")).when(F.col("before") == F.col("version_id"), F.lit("unchanged")).otherwise(F.lit("changed"))
    judged = judged.withColumn("status", status)
    changed = judged.where(F.col("status") != "unchanged")
    newest = changed.groupBy("item_id").agg(F.max(F.struct("path", "source_id", "external_id", "version_id")).alias("v"))
    out_items = newest.select(F.col("item_id").alias("id"), "v.source_id", "v.external_id", F.col("v.path").alias("locator"), F.lit("active").alias("state"), F.col("v.version_id").alias("current_version_id"), F.lit(tenant).alias("tenant_id"), at.alias("updated_at"))
    fresh = changed.groupBy("version_id").agg(F.min(F.struct("path", "item_id", "content_hash")).alias("v"))
    out_versions = fresh.join(versions.select(F.col("id").alias("version_id")), "version_id", "left_anti").select(F.col("version_id").alias("id"), F.col("v.item_id").alias("source_item_id"), "v.content_hash", at.alias("captured_at"), F.col("v.path").alias("content_ref"), F.lit(tenant).alias("tenant_id"))
    state = F.lit("available" if trusted else "unavailable")
    ids = fresh.select(F.concat(F.lit("ev:"), F.substring("v.content_hash", 1, 12)).alias("id"), F.col("version_id").alias("source_version_id"), "v.content_hash", state.alias("state"), F.lit(tenant).alias("tenant_id"), at.alias("created_at"))
    out_evidence = ids.join(evidence.select("id"), "id", "left_anti")
    items_new, skipped = judged.agg(F.countDistinct(F.when(F.col("status") == "new", F.col("item_id"))), F.count_if(F.col("status") == "unchanged")).first()
    made, shut = out_evidence.agg(F.count("*"), F.count_if(F.col("state") == "unavailable")).first()
    counts = (items_new, skipped, out_versions.count(), made, shut)
    report = files.sparkSession.createDataFrame([counts], "items_ingested long, skipped long, versions_created long, evidence_created long, quarantined long")
    return {"items": out_items, "versions": out_versions, "evidence": out_evidence, "report": report}


