"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def differences(spark, con, name, build, oracle, sf_dir):
    """Empty when both sides agree, else a short account. The row count comes along."""
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if oracle is None:
        return len(got), ""
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(names)}"
    odd = {
        c: (k, kinds[c]) for c, k in df.dtypes if _KINDS.get(k, k).lower() != kinds[c].lower()
    }
    if len(got) != len(want):
        return len(got), f"{len(got)} rows against {len(want)} {odd or ''}"
    a, b = canonical(df.columns, got), canonical(names, want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    note = f"types {odd}" if odd else ""
    if wrong:
        cols = sorted(names)
        pick = [
            {c: (p, q) for c, p, q in zip(cols, x, y) if p != q} for x, y in wrong[:2]
        ]
        note += f" {len(wrong)} of {len(a)} rows differ, e.g. {pick} in {wrong[0][0]}"
    return len(got), note


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from lanewise import build_session

    sf_dir, *only = sys.argv[1:]
    spark = build_session("local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": os.environ.get("COMPARE_ZONE", "UTC"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            rows, note = differences(spark, con, name, build, oracles.get(name), sf_dir)
        except Exception as error:  # report every query
            rows, note = -1, f"{type(error).__name__}: {str(error)[:400]}"
        bad += bool(note)
        flag = "BAD " if note else ("ok  " if name in oracles else "rows")
        print(f"{flag} {name} rows={rows} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} with differences of {len(queries)}; {len(oracles)} with SQL")


if __name__ == "__main__":
    main()
