"""Run registered queries on Spark and DuckDB and compare the values.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(_plain(row[i]) for i in order) for row in rows])


def difference(query, sql, spark, con, sf_dir) -> str | None:
    """None when both sides agree, else a short description."""
    got = query(spark, sf_dir)
    spark_cols, spark_rows = normal(got.columns, [tuple(r) for r in got.collect()])
    relation = con.sql(sql)
    duck_cols, duck_rows = normal(relation.columns, relation.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} / {duck_cols}"
    if spark_rows == duck_rows:
        return None
    only_spark = sorted(set(spark_rows) - set(duck_rows))[:2]
    only_duck = sorted(set(duck_rows) - set(spark_rows))[:2]
    return f"rows {len(spark_rows)} / {len(duck_rows)}; spark {only_spark}; duckdb {only_duck}"


if __name__ == "__main__":
    from turnlake.session import build_session
    from turnlake.verify.queries import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        started = time.time()
        try:
            if name in ORACLES:
                verdict = difference(QUERIES[name], ORACLES[name], spark, con, sf_dir) or "ok"
            else:
                verdict = f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - started:6.2f}s {verdict[:1800]}", flush=True)
