"""Continuous periods and gaps of overlapping intervals (problem 1).

Plan: one range exchange on (key, start, end) — a hot key is cut into several ranges like any other run of rows — then
two scans of the sorted, materialised partitions. The first scan reduces each partition to one summary row, the driver
combines those (one row a partition, whatever the data's size) from left to right, and the second scan gives every row
the state carried into its partition. No row is shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.session import cut, partitions

OPEN = 2**63 - 1
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
)
_BARE = r"^.{10}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)$"


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 date or date-time; null for any other text or an impossible date.

    A date is its midnight, a time without offset is UTC; both hold whatever the session's time zone is. The forms the
    cast reads as they are come first, so that the common row costs one pattern and no rewriting.
    """
    tail = F.substring(text, -6, 1)
    rare = F.concat(F.substring(text, 1, 10), F.lit("T"), F.regexp_replace(F.replace(F.upper(F.substring(text, 12, 60)), F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})$", "$1:$2"))
    full = (
        F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z")))
        .when(text.endswith("Z") & ~text.contains(","), text)
        .when((F.length(text) > 16) & tail.isin("+", "-") & ~text.contains(","), text)
        .when(text.rlike(_BARE), F.concat(text, F.lit("Z")))
        .otherwise(F.when(rare.rlike(r"(Z|[+-]\d{2}(:\d{2})?)$"), rare).otherwise(F.concat(rare, F.lit("Z"))))
    )
    return F.when(text.rlike(_ISO), F.unix_micros(full.try_cast("timestamp")))


def claim_intervals(claims: DataFrame) -> DataFrame:
    """(key, s, e) of every claim row that holds an interval; ``e`` is OPEN where it never ends.

    No interval: a null or empty subject, a ``valid_from`` that is no ISO date, a ``valid_to`` that is neither open nor
    later than ``valid_from``. Null and 9999-12-31 are open.
    """
    last = F.lit(253_402_214_400_000_000)  # 9999-12-31T00:00:00Z
    # parsed inside an array and unpacked by a generator: a filter moved below a projection would parse again and again
    parsed = F.transform(
        F.array(F.struct(iso_micros(F.col("valid_from")).alias("s"), F.when(F.col("valid_to").isNull(), F.lit(OPEN)).otherwise(iso_micros(F.col("valid_to"))).alias("e"))),
        lambda x: F.struct(x["s"].alias("s"), F.when(x["e"] >= last, F.lit(OPEN)).otherwise(x["e"]).alias("e")),
    )
    held = F.filter(parsed, lambda x: x["s"].isNotNull() & x["e"].isNotNull() & (x["e"] > x["s"]))
    return claims.where(F.col("subject_id").isNotNull() & (F.col("subject_id") != "")).select(F.col("subject_id").alias("key"), F.inline(held))


class _Run:
    """State carried along sorted rows: the last key, its greatest end so far and where its open island began."""

    def __init__(self, key: str | None = None, top: int = 0, begin: int = 0) -> None:
        self.key, self.top, self.begin = key, top, begin

    def read(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Islands that ended within ``rows`` and the gaps that precede new ones; the last island stays in the state."""
        key, s, e = rows["key"].to_numpy(), rows["s"].to_numpy(np.int64), rows["e"].to_numpy(np.int64)
        if self.key is not None:  # the carried island takes part as a row of its own
            key, s, e = np.r_[np.array([self.key], object), key], np.r_[self.begin, s], np.r_[self.top, e]
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(fresh)
        top = pd.Series(e).groupby(group, sort=False).cummax().to_numpy()
        before = np.r_[0, top[:-1]]
        starts = np.flatnonzero(fresh | (s > before))
        ends = np.r_[starts[1:] - 1, len(s) - 1]
        split = starts[~fresh[starts]]
        self.key, self.top, self.begin = key[-1], int(top[-1]), int(s[starts[-1]])
        periods = pd.DataFrame({"key": key[starts[:-1]], "s": s[starts[:-1]], "e": top[ends[:-1]]})
        return periods, pd.DataFrame({"key": key[split], "s": before[split], "e": s[split]})


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    run, first, pid = _Run(), None, 0
    for rows in batches:
        if len(rows):
            first = first or (rows["key"].iloc[0], int(rows["s"].iloc[0]))
            pid = int(rows["pid"].iloc[0])
            run.read(rows)
    if first:
        yield pd.DataFrame([[pid, *first, run.key, run.top, run.begin]], columns=["pid", "k0", "s0", "key", "top", "begin"])


def _combine(summaries: list) -> dict[int, tuple]:
    """partition -> (carried state, whether its last island goes on in the next partition)."""
    carried: dict[int, tuple] = {}
    key, top, begin = None, 0, 0
    rows = sorted(summaries, key=lambda r: r["pid"])
    for i, r in enumerate(rows):
        before = (key, top, begin)
        if r["key"] == key:
            begin = r["begin"] if r["begin"] > top else begin
            top = max(top, r["top"])
        else:
            key, top, begin = r["key"], r["top"], r["begin"]
        nxt = rows[i + 1] if i + 1 < len(rows) else None
        carried[r["pid"]] = (before, nxt is not None and nxt["k0"] == key and nxt["s0"] <= top)
    return carried


def _text(t: np.ndarray) -> np.ndarray:
    shown = np.char.add(np.datetime_as_string((t // 1_000_000).clip(-(10**11), 10**12).astype("datetime64[s]")), "Z")
    return np.where(t == OPEN, "open", shown)


def periods_and_gaps(intervals: DataFrame) -> DataFrame:
    """(key, kind, start_at, end_at) of (key, s, e): one row per continuous period and per gap between two of a key.

    Touching intervals are continuous; repeated and nested ones change nothing; an empty input gives an empty result.
    Needs e > s and no nulls (``claim_intervals`` sees to both). Times come out as UTC texts to the second.
    """
    # the count is explicit, so adaptive execution keeps partitions as ranged: whole runs in order of their numbers
    spread = intervals.select("key", "s", "e").repartitionByRange(partitions(intervals), "key", "s", "e").sortWithinPartitions("key", "s", "e")
    ranged = cut(spread.withColumn("pid", F.spark_partition_id()))
    summaries = ranged.mapInPandas(_summaries, "pid int, k0 string, s0 long, key string, top long, begin long").collect()
    carried = _combine(summaries)

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, goes_on, began = _Run(), False, False

        def out(kind: str, found: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"key": found["key"], "kind": kind, "start_at": _text(found["s"].to_numpy(np.int64)), "end_at": _text(found["e"].to_numpy(np.int64))})

        for rows in batches:
            if not len(rows):
                continue
            if not began:
                (key, top, begin), goes_on = carried[int(rows["pid"].iloc[0])]
                began = True
                # an earlier partition gave out the carried island of another key, or one that had ended
                same = key == rows["key"].iloc[0]
                if same:
                    run = _Run(key, top, begin)
                    skip = int(rows["s"].iloc[0]) > top
                else:
                    skip = False
                periods, gaps = run.read(rows)
                if skip:
                    periods = periods.iloc[1:]
            else:
                periods, gaps = run.read(rows)
            yield pd.concat([out("period", periods), out("gap", gaps)])
        if began and not goes_on:
            yield out("period", pd.DataFrame({"key": [run.key], "s": [run.begin], "e": [run.top]}))

    return ranged.mapInPandas(rescan, "key string, kind string, start_at string, end_at string")
