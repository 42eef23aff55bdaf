"""Run catalogue queries in Spark and in DuckDB and compare them row by row."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            db.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(df, db, sql: str) -> str | None:
    """What differs between a Spark frame and a DuckDB query, or None."""
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.sql(sql)
    want_columns, want = _rows(result.columns, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    types = sorted({(n, str(t)) for n, t in zip(result.columns, result.types, strict=True)})
    spark_types = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    mixed = [(a, b) for a, b in zip(spark_types, types, strict=True) if not _same_type(a[1], b[1])]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}"
    return f"types {mixed}" if mixed else None


def _same_type(spark: str, duck: str) -> bool:
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    }
    return names.get(spark, spark) == duck


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as entry
    from flowlens.session import local_session

    spark = local_session("compare", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls = oracle(folder), entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                found = difference(df, db, sqls[name])
                note = "ok" if found is None else f"DIFF {found}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as error:
            note = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
