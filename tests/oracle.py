"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def differences(spark, con, run, sql: str, sf_dir: str) -> list[str]:
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} expected {sorted(names)}"]
    kinds = {d[0]: str(d[1]) for d in result.description}
    for name, kind in df.dtypes:
        want = KINDS.get(kind, kind.upper().replace(" ", ""))
        if kinds[name].replace(" ", "") not in (want, "NUMBER", "STRING"):
            found.append(f"type of {name} is {kind}, expected {kinds[name]}")
    mine, theirs = _bag(df.columns, rows), _bag(names, expected)
    if len(rows) != len(expected):
        found.append(f"{len(rows)} rows, expected {len(expected)}")
    if mine != theirs:
        found.append(f"only Spark: {list((mine - theirs).items())[:3]}")
        found.append(f"only SQL: {list((theirs - mine).items())[:3]}")
    return found


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from paritas.queries import QUERIES
    from paritas.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    for name in wanted:
        start = time.time()
        try:
            problems = differences(spark, con, QUERIES[name].run, QUERIES[name].sql, sf_dir)
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.1f}s", *problems, sep="\n    " if problems else " ")
