"""Compare catalog queries with their SQL: ``python check.py [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

from docloom.catalog import ORACLE_SQL, QUERIES
from docloom.session import get_spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    left = _rows(df.columns, df.collect())
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    right = _rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            if name in ORACLE_SQL:
                problem = compare(spark, con, name, sf_dir)
            else:
                n = QUERIES[name](spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as error:  # a failing query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in ORACLE_SQL else '(rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
