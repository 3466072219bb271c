"""The memory as append-only Parquet tables under one folder, published batch by batch.

A batch writes its rows beside what is there and then publishes itself by creating the next manifest, a file that lists
the batches that count. Creating it fails where another writer has created it first, so a batch is visible whole or not
at all, in all tables at once. Readers take the newest manifest; older ones stay readable as of their batch.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.schema import SCHEMA_VERSION, TABLES

#: Columns that an upsert by column replaces; the others keep what was written first.
CHANGING = {
    "objects": ("type", "name", "aliases", "lifecycle_state", "redirect_to", "sensitivity", "updated_at"),
    "claims": ("lifecycle_state", "support_state", "confidence", "sensitivity", "updated_at"),
    "relationships": ("lifecycle_state", "support_state", "confidence", "sensitivity", "updated_at"),
    "evidence": ("state",),
    "gaps": ("lifecycle_state", "resolved_at"),
}
#: Tables whose first row of an id stays whatever comes later.
WRITE_ONCE = ("source_versions", "provenance", "journal")


class Conflict(RuntimeError):
    """Another batch was published first."""


#: The type of ``_seq``: wide enough for any version beside any place in a batch.
SEQ = "DECIMAL(38,0)"


def place(version: int, at: Column) -> Column:
    """A row's place in the order of writing: its version, then its place ``at`` in the batch, 63 bits."""
    return (F.lit(str(version << 64)).cast(SEQ) + at.cast("DECIMAL(20,0)")).cast(SEQ)


class Store:
    """``folder``: any file system Spark can write. Rows carry ``_seq``, their place in the order of writing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests -------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The number of the newest manifest; 0 where nothing is published."""
        home = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(home):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(home)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if n == 0:
            return {"schema": SCHEMA_VERSION, "tables": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{n:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, n: int, content: dict) -> None:
        """Write aside, then rename onto a name that must be free: whole or not there, and one writer only."""
        target, aside = self._path(f"{self.folder}/manifests/{n:010d}.json"), self._path(f"{self.folder}/manifests/.{n:010d}-{content['batch']}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {n} of {self.folder} is published already")

    # Reading ---------------------------------------------------------------------------------------------------

    def rows(self, table: str, version: int | None = None) -> DataFrame:
        """Every row written to ``table``, as of a version."""
        batches = self.manifest(version)["tables"].get(table, [])
        if not batches:
            return self.spark.createDataFrame([], f"{TABLES[table]}, _seq {SEQ}")
        return self.spark.read.schema(f"{TABLES[table]}, _seq {SEQ}").parquet(*[f"{self.folder}/tables/{table}/{b}" for b in batches])

    def table(self, table: str, version: int | None = None, by_column: bool = False, where: Column | None = None) -> DataFrame:
        """The current rows with ``_seq`` and, of the first row of the id, ``_first_seq``: per id the last one whole, or,
        ``by_column``, upserted column by column. ``where``: a condition on ``id``, put to the rows before they meet."""
        rows = self.rows(table, version)
        rows = rows if where is None else rows.where(where)
        if "id" not in rows.columns:
            return rows
        columns = [c for c in rows.columns if c not in ("id", "_seq")]
        once = table in WRITE_ONCE
        fixed = columns if once else [c for c in columns if by_column and c not in CHANGING.get(table, columns)]
        changing = [c for c in columns if c not in fixed]
        a, b = F.min(F.struct("_seq", *fixed)).alias("a"), F.max(F.struct("_seq", *changing)).alias("b")
        found = rows.groupBy("id").agg(a, b)
        return found.select("id", *[f"a.{c}" if c in fixed else f"b.{c}" for c in columns], F.col("a._seq" if once else "b._seq").alias("_seq"), F.col("a._seq").alias("_first_seq"))

    def get(self, table: str, key: str) -> dict:
        """One current row as a dict; KeyError where there is none."""
        found = self.table(table, where=F.col("id") == key).collect()
        if not found:
            raise KeyError(f"{table}: {key} not found")
        return found[0].asDict(recursive=True)

    def last_sequence(self) -> int:
        """The greatest sequence of the journal, kept by each batch."""
        known = self.manifest().get("sequence")
        return known if known is not None else self.rows("journal").agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]

    # Writing ---------------------------------------------------------------------------------------------------

    def commit(self, changes: dict[str, DataFrame], order: str | None = None, replace: tuple[str, ...] = ()) -> int:
        """Append rows to several tables as one batch; gives the version. Columns left out are null. Of tables in
        ``replace`` only the new rows count from now on.

        ``_seq`` grows from batch to batch and, within one, in the order of ``order``, a column that need not belong
        to the table; it has holes.
        """
        before = self.version()
        content = self.manifest(before)
        batch = f"{before + 1:010d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()[:8]}"
        tables = {k: list(v) for k, v in content["tables"].items()}
        for name, rows in changes.items():
            schema = self.spark.createDataFrame([], TABLES[name]).schema
            if order and order in rows.columns:
                rows = rows.repartitionByRange(order).sortWithinPartitions(order)
            shaped = rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema], place(before + 1, F.monotonically_increasing_id()).alias("_seq"))
            shaped.write.parquet(f"{self.folder}/tables/{name}/{batch}")
            tables[name] = [batch] if name in replace else [*tables.get(name, []), batch]
        last = content.get("sequence", 0 if not content["tables"].get("journal") else self.last_sequence())
        if "journal" in changes:
            written = self.spark.read.schema(f"{TABLES['journal']}, _seq {SEQ}").parquet(f"{self.folder}/tables/journal/{batch}")
            last = max(last, written.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0])
        self._publish(before + 1, {"schema": SCHEMA_VERSION, "batch": batch, "tables": tables, "sequence": last})
        return before + 1

    def compact(self, table: str) -> int:
        """Rewrite a table as one batch of each id's first and last row, so that nothing that can be asked of it
        changes; older versions stay readable."""
        content = self.manifest()
        n = self.version() + 1
        batch = f"{n:010d}-compact-{self.spark._jvm.java.util.UUID.randomUUID().toString()[:8]}"
        rows = self.rows(table)
        kept = rows
        if "id" in rows.columns:
            whole = F.struct("_seq", *[c for c in rows.columns if c not in ("id", "_seq")])
            ends = rows.groupBy("id").agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
            last = F.when(F.col("b._seq") > F.col("a._seq"), F.array("a", "b")).otherwise(F.array("a"))
            kept = ends.select("id", F.explode(last).alias("v")).select(*[F.col("id") if c == "id" else F.col(f"v.{c}").alias(c) for c in rows.columns])
        kept.write.parquet(f"{self.folder}/tables/{table}/{batch}")
        self._publish(n, {**content, "batch": batch, "tables": {**content["tables"], table: [batch]}})
        return n

    # Exchange with other stores --------------------------------------------------------------------------------

    def export_json(self, table: str, folder: str) -> None:
        """The current rows as JSON lines, arrays and structs as JSON."""
        self.table(table).drop("_seq", "_first_seq").write.json(folder)

    def import_json(self, table: str, folder: str) -> int:
        """Append rows from JSON lines; fields that are missing or of another type are null."""
        return self.commit({table: self.spark.read.schema(TABLES[table]).json(folder)})
