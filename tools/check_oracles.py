"""Compare every registered query with its DuckDB oracle on one scale.

    python tools/check_oracles.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(con, spark, folder, fn, sql) -> str:
    """Empty text when both sides agree, else a description of the first difference."""
    df = fn(spark, folder)
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if spark_rows else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_columns, duck_rows = rows_of(names, result.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} != {duck_columns}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows != {len(duck_rows)}"
    wrong = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(spark_rows)} rows differ, e.g. {wrong[0]}"
    return ""


def main() -> int:
    from cohortry.catalog import ORACLES, QUERIES
    from cohortry.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failures = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(con, spark, folder, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{len(names) - failures}/{len(names)} agree")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
