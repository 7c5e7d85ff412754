"""Run named queries in Spark and their SQL twins in DuckDB and report differences.

    python tests/parity.py [folder] [name-part ...]
"""

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DIGITS = int(os.environ.get("PARITY_DIGITS", "9"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.{DIGITS}g}")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _key(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def compare(spark, con, name, query, sql, folder):
    """None when equal, else a short description."""
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in names) for r in df.collect()), key=_key)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    at = [cols.index(c) for c in names]
    want = sorted((tuple(_cell(r[i]) for i in at) for r in res.fetchall()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{dict(zip(names, g))} against {dict(zip(names, w))}"
    return None


if __name__ == "__main__":
    from tillview.plans import registry
    from tillview.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(8, shared=tempfile.mkdtemp(prefix="tillview-parity-")), connect(folder)
    queries, sql, bad = registry.all_queries(), registry.all_sql(), 0
    for name, query in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, query, sql[name], folder) if name in sql else f"no SQL, {query(spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None and name in sql
        print(f"{'ok  ' if diff is None else 'DIFF' if name in sql else 'info'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("SQL without a query:", sorted(set(sql) - set(queries)))
    print("differences:", bad)
