"""Run registered queries beside their SQL in DuckDB and report differences and seconds.

    python tests/oracle_check.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r))


def compare(a_cols, a, b_cols, b):
    ca, ra = rows_of(a_cols, a)
    cb, rb = rows_of(b_cols, b)
    if ca != cb:
        return f"COLUMNS {ca} vs {cb}"
    if len(ra) != len(rb):
        return f"ROWS {len(ra)} vs {len(rb)}"
    if not ra:
        return "EMPTY"
    sa, sb = set(ra), set(rb)
    if sa == sb:
        for i, c in enumerate(ca):
            ta = {type(r[i]).__name__ for r in ra} - {"NoneType"}
            tb = {type(r[i]).__name__ for r in rb} - {"NoneType"}
            if ta != tb:
                return f"TYPES {c} {ta} {tb}"
        return "ok"
    only_a, only_b = sorted(sa - sb, key=str), sorted(sb - sa, key=str)
    return f"VALUES {len(only_a)} differ {ca}: {only_a[:2]} vs {only_b[:2]}"


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    import __spark_entry__ as entry
    from screenforge.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    q, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            df = q[name](spark, args.sf)
            got = df.collect()
            took = time.time() - t
            if name not in sql:
                verdict = f"rows {len(got)} (no SQL)"
            else:
                r = con.execute(sql[name])
                cols = [d[0] for d in r.description]
                verdict = compare(df.columns, [tuple(x) for x in got], cols, r.fetchall())
        except Exception as e:  # report and go on with the next query
            took, verdict = time.time() - t, "ERROR " + str(e).replace("\n", " ")[:500]
        if verdict != "ok" and "(no SQL)" not in verdict:
            bad += 1
        print(f"{name:42s} {took:6.2f}s {len(got) if 'got' in dir() else 0:7d} {verdict}", flush=True)
    print("not ok:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
