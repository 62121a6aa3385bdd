"""Compare queries with their SQL on one data folder: ``python -m workloads.check SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark: SparkSession, sf_dir: str, name: str, query, sql: str | None) -> str:
    start = time.time()
    got = query(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(got)} ({took:.1f}s)"
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    start = time.time()
    want = con.execute(sql).fetchdf()
    sql_took = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} <> {sorted(want.columns)}"
    types = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype != want[c].dtype}
    a, b = canonical(got), canonical(want)
    if a != b:
        only_a, only_b = list((set(a) - set(b)))[:2], list((set(b) - set(a)))[:2]
        return f"DIFF rows {len(a)} {len(b)}\n   cols {sorted(got.columns)}\n   spark {only_a}\n   sql   {only_b}"
    return f"ok {len(got)} rows ({took:.1f}s, sql {sql_took:.1f}s)" + (f" types {types}" if types else "")


def main() -> None:
    import workloads.catalog_more  # noqa: F401
    from workloads.catalog import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        try:
            print(name, compare(spark, sf_dir, name, q, ORACLES.get(name)), flush=True)
        except Exception as exc:  # noqa: BLE001
            print(name, "ERROR", type(exc).__name__, str(exc)[:700], flush=True)


if __name__ == "__main__":
    main()
