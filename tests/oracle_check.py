"""Run registered queries beside their SQL twins: python -m tests.oracle_check [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal",):
        f = float(v)
        return None if math.isnan(f) else (0.0 if f == 0 else f)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def alike(a, b):
    """Equal up to the last digit that a rounded sum may lose to its order."""
    return len(a) == len(b) and all(
        p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-7)) for p, q in zip(a, b))


def compare(spark_df, con, sql):
    """Empty text when both sides agree, else the first difference."""
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}: {ours[:2]} / {theirs[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b and not alike(a, b)]
    return f"{len(bad)} of {len(ours)} rows differ: {bad[:2]}" if bad else ""


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from perfspark.runtime import session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = session(**{"spark.master": "local[8]", "spark.driver.memory": "12g",
                       "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                       "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = 0
    for n in names:
        start, flags = time.time(), []
        try:
            df = queries[n](spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
            flags = [f for f in ("CartesianProduct", "NestedLoop") if f in plan]
            if n in oracles:
                mid = time.time()
                msg = compare(df, con, oracles[n]) or "ok"
            else:
                msg = f"rows {len(df.collect())} (no SQL)"
        except Exception as e:  # noqa: BLE001 - a report line per query
            msg = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += not (msg == "ok" or msg.startswith("rows") and "no SQL" in msg)
        print(f"{n:32s} {time.time()-start:6.2f}s {msg}", *flags, flush=True)
    print("failed", failed, "of", len(names))


if __name__ == "__main__":
    main()
