"""Numbering, and looking at the row before, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.session import cut, partitions


def numbered(rows: DataFrame, order: list[str], column: str, start: int = 1) -> DataFrame:
    """``rows`` with ``column`` counting from ``start`` in order of ``order``, without holes.

    Rows are ranged and sorted, then each partition adds the number of rows before it: one count a partition comes to
    the driver, whatever the number of rows. Ties are numbered in some order, each number once.
    """
    ranged = cut(rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())
    pid, nth = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = list(accumulate((n for _, n in counts), initial=start))
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "__p int, __start long")
    # one row a partition
    numbers = placed.withColumn("__p", pid).join(F.broadcast(offsets), "__p")
    return numbers.withColumn(column, F.col("__start") + nth).drop("__at", "__p", "__start")


def lagged(rows: DataFrame, group: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``column`` of the row before in the same group, null for a group's first.

    A group may span partitions: rows are ranged by group and order, and each partition starts from the last row of the
    one before it, of which one a partition comes to the driver. Groups and order must not hold nulls.
    """
    keys = [*group, *order]
    ranged = cut(rows.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys).withColumn("__pid", F.spark_partition_id()))
    ends = ranged.groupBy("__pid").agg(F.max(F.struct(*keys, F.col(column).alias("__value"))).alias("v")).select("__pid", *[F.col(f"v.{g}").alias(g) for g in group], "v.__value").collect()
    before, last = {}, None
    for r in sorted(ends, key=lambda r: r["__pid"]):
        before[r["__pid"]] = last
        last = (tuple(r[g] for g in group), r["__value"])

    def look_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, begun = None, False
        for b in batches:
            if not len(b):
                continue
            if not begun:
                held, begun = before[int(b["__pid"].iloc[0])], True
            of = list(zip(*[b[g] for g in group], strict=True))
            values = list(b[column])
            shifted = [v if k0 == k else None for (k0, v), k in zip([held or (None, None), *zip(of[:-1], values[:-1], strict=True)], of, strict=True)]
            held = (of[-1], values[-1])
            yield b.drop(columns="__pid").assign(**{out: pd.Series(shifted, index=b.index, dtype=object)})

    kind = ranged.schema[column].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` {kind}"])
    return ranged.mapInPandas(look_back, schema)
