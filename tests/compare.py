"""Run registered queries next to their reference SQL and report differences.

Usage: python tests/compare.py SF_DIR [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def sql_rows(con, sql: str):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, [str(d[1]) for d in found.description], found.fetchall()


def ordered(names, rows):
    """Rows with columns by name, in a canonical order."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    names, types, expected = sql_rows(con, sql)
    got = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    short = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}
    short["BOOLEAN"] = "boolean"
    spark_types = dict(spark_df.dtypes)
    for n, t in zip(names, types):
        if short.get(t, t) != spark_types[n]:
            return f"type of {n}: {spark_types[n]} != {t}"
    got, expected = ordered(spark_df.columns, got), ordered(names, expected)
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from layerscan.session import local_session

    sf_dir, *chosen = sys.argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        df = query(spark, sf_dir)
        sql = oracle_sql().get(name)
        problem = differences(df, con, sql) if sql else f"no SQL, {df.count()} rows"
        print(f"{name:26} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
