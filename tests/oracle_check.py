"""Compare registered queries with their SQL: `python tests/oracle_check.py <sf_dir> [name ...]`."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, values exactly as they are."""
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(spark_df, sql: str, con) -> str:
    """Empty when both sides hold the same rows, otherwise what differs."""
    left, right = spark_df.toPandas(), con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} and {len(right)}"
    left, right = canonical(left), canonical(right)
    out = []
    for name in left.columns:
        a, b = left[name], right[name]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            out.append(f"{name}: {(~same).sum()} of {len(same)}, first {a[i]!r} and {b[i]!r}")
        kinds = {a.dtype.kind, b.dtype.kind}
        if len(kinds) > 1 and not (a.isna().any() and kinds <= set("iuf")):
            out.append(f"{name}: type {a.dtype} and {b.dtype}")
    return "; ".join(out)


def main() -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from skuweave.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle check", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            result = fn(spark, sf_dir)
            if name in sql:
                problem = differences(result, sql[name], con)
            else:
                problem = "" if result.count() >= 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.1f}s {name} {problem}",
              flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
