"""Session helpers: shared folder for cut lineages, parallelism of the running cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, as the session names it.

    Where it names none, a private folder, gone with the process, serves a session on one machine (tests, laptops); on
    a cluster, whose executors could not reach it, that is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="mnemora-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs a read and partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _held(spark: SparkSession, leaf: JavaObject) -> int:
    """Bytes of a plan's leaf: a checkpoint's files as they lie there, else Spark's estimate; 0 where it has none."""
    if leaf.nodeName() == "LogicalRDD" and (written := leaf.rdd().getCheckpointFile()).isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(written.get())
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    size = int(str(leaf.stats().sizeInBytes()))
    return size if size < spark._jsparkSession.sessionState().conf().defaultSizeInBytes() else 0


def partitions(rows: DataFrame, each: int = 256 << 20) -> int:
    """How many ranges to cut ``rows`` into: as many as the session shuffles to, more where the input is larger than
    ``each`` bytes a range: by the plan's own estimate, and no more than all its leaves hold. The estimate of a join is
    the product of its sides, and a checkpoint carries it on."""
    spark, plan = rows.sparkSession, rows._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = min(int(str(plan.stats().sizeInBytes())), sum(_held(spark, leaves.apply(i)) for i in range(leaves.size())))
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(size // each, 1_000_000))
