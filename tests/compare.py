"""Run registered queries on Spark and their SQL on DuckDB, and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, int):
        return str(float(value))
    if isinstance(value, float):
        return None if math.isnan(value) else str(round(value + 0.0, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([norm(v) for v in value])
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, x or "") for x in r)
    )
    return names, data


def diff(spark_df, con, sql):
    left = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    right = table([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}", len(left[1])
    if len(left[1]) != len(right[1]):
        extra = [r for r in left[1] if r not in set(right[1])][:2]
        missing = [r for r in right[1] if r not in set(left[1])][:2]
        return f"rows {len(left[1])} vs {len(right[1])}; spark-only {extra}; sql-only {missing}", len(left[1])
    for a, b in zip(left[1], right[1]):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y]
            return f"values {bad[:4]} in {str(a)[:300]}", len(left[1])
    huge = [n for n, t in types.items() if "HUGEINT" in t or t.startswith("DECIMAL")]
    if huge:
        return f"types: {huge} should be cast in the SQL", len(left[1])
    return None, len(left[1])


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as e
    from runlens.session import local_session

    folder = argv[0]
    spark = local_session("compare", cores="8")
    con = duck(folder)
    qs, os_ = e.queries(), e.oracle_sql()
    names = [n for n in qs if not argv[1:] or any(p in n for p in argv[1:])]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, folder)
            if n in os_:
                err, rows = diff(df, con, os_[n])
            else:
                rows, err = len(df.collect()), None
        except Exception as exc:  # noqa: BLE001
            err, rows = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        bad += err is not None
        mark = "ok  " if err is None else "FAIL"
        print(f"{mark} {n:28s} rows={rows:7d} {time.time()-t0:6.2f}s {'' if n in os_ else '(no sql)'} {err or ''}", flush=True)
    print("failed:", bad, "of", len(names), "oracles:", len([n for n in names if n in os_]))


if __name__ == "__main__":
    main(sys.argv[1:])
