"""Run queries and oracles side by side: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as spark_entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def differences(ours: pd.DataFrame, expected: pd.DataFrame) -> str:
    """Empty if both frames hold the same rows, column types included."""
    if sorted(ours.columns) != sorted(expected.columns):
        return f"columns {sorted(ours.columns)} / {sorted(expected.columns)}"
    if len(ours) != len(expected):
        return f"{len(ours)} rows / {len(expected)} rows"
    names = sorted(ours.columns)
    for name in names:
        # a long column with nulls: doubles here, nullable integers there
        if ours[name].dtype.kind == "f" and expected[name].dtype.kind == "i":
            if (ours[name].dropna() % 1 == 0).all():
                ours = ours.assign(**{name: ours[name].astype("Int64")})
    kinds = [(n, ours[n].dtype.kind, expected[n].dtype.kind) for n in names]
    if any(a != b for _, a, b in kinds):
        return f"types {[k for k in kinds if k[1] != k[2]]}"

    def ordered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[names].astype(object).where(frame[names].notna(), None)
        return frame.map(repr).sort_values(names).reset_index(drop=True)

    left, right = ordered(ours), ordered(expected)
    unequal = (left != right).any(axis=1)
    if unequal.any():
        at = unequal.idxmax()
        return f"{unequal.sum()} rows differ: {left.loc[at].to_dict()} / {right.loc[at].to_dict()}"
    return ""


def main(arguments: list[str]) -> int:
    from pyspark.sql import SparkSession

    sf = arguments[0] if arguments else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    queries, oracles = spark_entry.queries(), spark_entry.oracle_sql()
    failed = 0
    for name in arguments[1:] or queries:
        started = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
            seconds = time.time() - started
            if name in oracles:
                problem = differences(ours, connection.execute(oracles[name]).df())
            else:
                problem = "" if len(ours) else "no rows"
            status = "ok" if not problem else f"FAILED {problem}"
        except Exception as error:  # report and go on with the next query
            seconds, status = time.time() - started, f"ERROR {str(error)[:600]}"
        failed += not status.startswith("ok")
        kind = "sql" if name in oracles else "rows"
        print(f"{name:22} {kind:5} {seconds:6.2f}s {status}", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
