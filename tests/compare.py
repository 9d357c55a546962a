"""Run registered queries against their DuckDB oracle: python -m tests.compare [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


def normalised(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, gc = normalised(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, wc = normalised(names, cur.fetchall())
    if gc != wc:
        return f"columns {gc} vs {wc}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ of {len(got)}, first\n   spark {dict(zip(gc, bad[0][0]))}\n   duck  {dict(zip(gc, bad[0][1]))}", len(got)
    return None, len(got)


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from seastate.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    qs, oracles, failed = entry.queries(), entry.oracle_sql(), 0
    wanted = [n for n in qs if not args[1:] or any(n.startswith(a) for a in args[1:])]
    for name in wanted:
        t = time.time()
        try:
            if name in oracles:
                msg, n = compare(spark, con, qs[name], oracles[name], sf_dir)
            else:
                msg, n = None, qs[name](spark, sf_dir).count()
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:500]}", 0
        failed += bool(msg)
        flag = "FAIL" if msg else ("ok  " if name in oracles else "rows")
        print(f"{flag} {name} rows={n} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
