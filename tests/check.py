"""Compare queries with their SQL on one data folder: python tests/check.py FOLDER [NAME ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 8)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(row[i]) for i in order) for row in rows]
    data.sort(key=lambda r: tuple((v is not None, str(v)) for v in r))
    return sorted(columns), data


def compare(spark, con, name: str, query, sql: str | None, folder: str) -> str:
    begun = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - begun
    if sql is None:
        return f"rows  {name:22} {len(got[1]):8} rows {spent:6.1f}s"
    begun = time.time()
    result = con.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    checked = time.time() - begun
    if got == want:
        return f"ok    {name:22} {len(got[1]):8} rows {spent:6.1f}s, SQL {checked:5.1f}s"
    where = next((i for i, (a, b) in enumerate(zip(got[1], want[1])) if a != b), None)
    detail = "" if where is None else f"\n      {str(got[1][where])[:300]}\n      {str(want[1][where])[:300]}"
    return f"WRONG {name:22} columns {got[0]} / {want[0]}, rows {len(got[1])} / {len(want[1])}{detail}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from songloom.session import local_session

    data, wanted = sys.argv[1], sys.argv[2:]
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(data)
    failures = 0
    for key, function in queries().items():
        if wanted and key not in wanted:
            continue
        try:
            line = compare(session, connection, key, function, oracle_sql().get(key), data)
        except Exception as error:  # report and go on with the next query
            line = f"ERROR {key:22} {str(error)[:700]}"
        failures += line.startswith(("WRONG", "ERROR"))
        print(line, flush=True)
    print(f"{failures} failures")
    session.stop()
