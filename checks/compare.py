"""Run registered queries against their SQL and report what differs.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqprep-checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=0, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """``None`` when schema and all values agree, else the first difference."""
    found = con.execute(sql)
    described = sorted((d[0], str(d[1])) for d in found.description)
    expected_rows = found.fetchall()
    names = [d[0] for d in found.description]
    spark_types = dict(df.dtypes)
    if sorted(spark_types) != sorted(names):
        return f"columns {sorted(spark_types)} and {sorted(names)}"
    for name, kind in described:
        if TYPES.get(kind) != spark_types[name]:
            return f"type of {name}: {spark_types[name]} and {kind}"
    ordered = sorted(names)
    at = [names.index(n) for n in ordered]
    expected = sorted((tuple(r[i] for i in at) for r in expected_rows), key=_key)
    actual = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in ordered]).collect()), key=_key)
    if len(actual) != len(expected):
        return f"{len(actual)} rows and {len(expected)}"
    if not actual:
        return "no rows"
    if any(v is None for row in actual for v in row):
        return "nulls, which other tools may compare differently"
    for a, b in zip(actual, expected):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return None


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    from checks.oracle import sql
    from checks.queries import QUERIES

    spark, con, oracle, bad = session(), database(sf_dir), sql(), 0
    for name in names or QUERIES:
        if name not in oracle:
            print(f"{name}: {QUERIES[name](spark, sf_dir).count()} rows, no SQL")
            continue
        began = time.time()
        try:
            found = difference(QUERIES[name](spark, sf_dir), con, oracle[name])
        except Exception as error:  # keep going: this is a report
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name}: {'ok' if found is None else found} ({time.time() - began:.1f}s)", flush=True)
    for name in set(oracle) - set(QUERIES):
        print(f"{name}: SQL without a query")
        bad += 1
    print(f"{bad} of {len(names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
