"""The memory's tables in a relational database, through JDBC.

Arrays and structs are JSON text there, as most databases hold no others; times are timestamps. Needs the database's
driver on Spark's class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, TimestampNTZType

from mnemora.operators.mutations import latest
from mnemora.schema import TABLES

#: Columns that an upsert into a database replaces although a store by column keeps the first: rows may change tenant.
TENANT = "tenant_id"


def _schema(spark: SparkSession, table: str) -> StructType:
    return spark.createDataFrame([], TABLES[table]).schema


def encoded(rows: DataFrame) -> DataFrame:
    """``rows`` with arrays and structs as JSON text; a null one is null."""
    out = []
    for f in rows.schema:
        c = F.col(f.name)
        nested = isinstance(f.dataType, ArrayType | StructType)
        out.append((F.when(c.isNotNull(), F.to_json(c, {"ignoreNullFields": "false"})) if nested else c.cast("timestamp") if isinstance(f.dataType, TimestampNTZType) else c).alias(f.name))
    return rows.select(*out)


def decoded(rows: DataFrame, table: str) -> DataFrame:
    """Rows of a database as the table's: JSON text read, columns that are missing null; text that is no JSON is null."""
    out = []
    held = {c.lower(): c for c in rows.columns}
    for f in _schema(rows.sparkSession, table):
        c = F.col(f"`{held[f.name.lower()]}`") if f.name.lower() in held else F.lit(None)
        nested = isinstance(f.dataType, ArrayType | StructType)
        out.append((F.from_json(c.cast("string"), f.dataType) if nested else c.cast(f.dataType)).alias(f.name))
    return rows.select(*out)


def read_table(spark: SparkSession, url: str, table: str, name: str | None = None, split: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table of the memory from the database; with ``split``, a numeric column, and its ``bounds`` read in ``parts``
    parallel ranges. Filters and columns asked for go down to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name or table, **options)
    if split and bounds:
        reader = reader.options(partitionColumn=split, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return decoded(reader.load(), table)


def write_table(rows: DataFrame, url: str, table: str, name: str | None = None, mode: str = "append", parts: int = 64, **options: str) -> None:
    """Rows of the memory's table into the database, over at most ``parts`` connections."""
    shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _schema(rows.sparkSession, table)])
    encoded(shaped).write.format("jdbc").options(url=url, dbtable=name or table, numPartitions=str(parts), **options).mode(mode).save()


def upserted(stored: DataFrame, changes: DataFrame, changing: tuple[str, ...], order: str) -> DataFrame:
    """What a table holds after an upsert by column: of ids held the ``changing`` columns and the tenant are those of
    the last change, the others as stored; new ids come whole, by their last change. Null ids are no rows."""
    columns = [c for c in stored.columns if c != "id"]
    newest = latest(changes.where(F.col("id").isNotNull()), "id", order, columns).drop(order)
    renamed = newest.select("id", F.lit(True).alias("__n"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = stored.withColumn("__s", F.lit(True)).join(renamed, "id", "full")
    taken = [F.when(F.col("__n").isNotNull() & (F.col("__s").isNull() | F.lit(c in changing or c == TENANT)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select("id", *taken).select(*stored.columns)
