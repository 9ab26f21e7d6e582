"""Compare registered queries with their SQL: check.py <sf_dir> [names...]."""

from __future__ import annotations

import sys
import time

import duckdb

from gavel.plans import QUERIES, SQL
from gavel.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if value != value else value + 0.0
    return value


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_gaps(df, result) -> list[str]:
    """Columns whose Spark type and SQL type differ."""
    sql_types = {d[0]: str(d[1]) for d in result.description}
    return [
        f"{name}: {kind} vs {sql_types[name]}"
        for name, kind in df.dtypes
        if TYPES.get(kind, kind) != sql_types[name]
    ]


def compare(spark, con, name: str, sf_dir: str) -> str:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(normal(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    took = time.time() - started
    if name not in SQL:
        return f"rows-only {len(rows)} rows {took:.2f}s"
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"COLUMNS {columns} vs {sorted(names)}"
    gaps = type_gaps(df, result)
    if gaps:
        return f"TYPES {gaps}"
    order = [names.index(c) for c in columns]
    wanted = [tuple(normal(r[i]) for i in order) for r in result.fetchall()]
    rows.sort(key=repr)
    wanted.sort(key=repr)
    if rows == wanted:
        return f"ok {len(rows)} rows {took:.2f}s (+sql {time.time() - started - took:.2f}s)"
    bad = [(a, b) for a, b in zip(rows, wanted) if a != b][:3]
    return f"MISMATCH {len(rows)} vs {len(wanted)} rows; {columns} {bad}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = 0
    for name in names:
        try:
            outcome = compare(spark, con, name, sf_dir)
        except Exception as error:  # report every query
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += not outcome.startswith(("ok", "rows-only"))
        print(f"{name}: {outcome}", flush=True)
    print(f"{len(names) - failed}/{len(names)} good")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
