"""Runs registered queries beside their SQL and compares rows: python tests/oracle.py [--dir D] [NAME...]"""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def rows_of(pdf: pd.DataFrame) -> Counter:
    columns = sorted(pdf.columns)
    return Counter(tuple(map(_cell, r)) for r in pdf[columns].itertuples(index=False))


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def difference(spark, d: str, name: str) -> str:
    import __spark_entry__ as e

    t = time.time()
    got = e.queries()[name](spark, d).toPandas()
    took = time.time() - t
    if name not in e.oracle_sql():
        return f"rows only: {len(got)} in {took:.1f} s"
    want = connect(d).execute(e.oracle_sql()[name]).fetch_df()
    if sorted(got.columns) != sorted(want.columns):
        return f"DIFFERENT columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        return f"DIFFERENT rows {len(got)} / {len(want)}; ours only {list((a - b).items())[:3]}; theirs only {list((b - a).items())[:3]}"
    return f"equal: {len(got)} rows in {took:.1f} s"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    args = sys.argv[1:]
    d = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        d, args = args[1], args[2:]
    spark = session()
    for name in args or entry.queries():
        try:
            print(name, difference(spark, d, name), flush=True)
        except Exception as x:
            print(name, "FAILED", str(x)[:1500], flush=True)
