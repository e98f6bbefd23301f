"""Run registered queries on Spark and on DuckDB and compare the rows.

    python -m tests.compare SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("freshet-checks")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(spark, query, sf_dir):
    df = query(spark, sf_dir)
    return df.dtypes, [tuple(r) for r in df.collect()]


def difference(dtypes, got, con, sql) -> str | None:
    got_columns = [name for name, _ in dtypes]
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {got_columns} != {want_columns}"
    types = {d[0]: str(d[1]) for d in result.description}
    wrong = {n: (t, types[n]) for n, t in dtypes if DUCK_TYPES.get(t) != types[n]}
    if wrong:
        return f"types {wrong}"
    a, b = canonical(got_columns, got), canonical(want_columns, want)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} vs {len(b)} rows\n  spark {only_a}\n  duck  {only_b}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = local_session(), duck(sf_dir)
    runs, expected = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or runs:
        start, took = time.time(), 0.0
        try:
            dtypes, rows = spark_rows(spark, runs[name], sf_dir)
            took = time.time() - start
            if name in expected:
                note = difference(dtypes, rows, con, expected[name])
            else:
                note = None if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            note = f"{type(error).__name__}: {str(error)[:600]}"
        bad += note is not None
        mark = "ok " if note is None else "BAD"
        kind = "O" if name in expected else "R"
        size = len(rows) if note is None else ""
        print(f"{mark} {kind} {name} {took:.2f}s {size} {note or ''}", flush=True)
    print(f"{len(names or runs)} queries, {bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
