"""Run the registered queries on Spark and their SQL on DuckDB and compare all rows.

python tests/compare.py SF_DIR [QUERY ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(r[i] for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, "" if v is None else v) for v in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs first."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs) if not all(map(same, a, b))]
    return f"{len(bad)} of {len(mine)} rows, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark, con, sf_dir = session(), duck(sys.argv[1]), sys.argv[1]
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        if name not in sqls:
            print(f"{name:32s} rows only: {queries[name](spark, sf_dir).count()}", flush=True)
            continue
        try:
            diff = difference(spark, con, queries[name], sqls[name], sf_dir)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {'ok' if diff is None else 'DIFFERS ' + diff}", flush=True)
