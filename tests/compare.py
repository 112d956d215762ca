"""Run registered queries beside their SQL twins and report differences.

python tests/compare.py [sf] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(path):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", repr(v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None else (type(v).__name__, v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, queries, oracle, path):
    """None if equal, else what differs."""
    df = queries[name](spark, path)
    cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracle:
        return None if got else "no rows"
    res = con.execute(oracle[name])
    want_cols, want = rows([d[0] for d in res.description], res.fetchall())
    if not want:
        return "twin gives no rows"
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        first = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first: {first[:4]} in {g[:6]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from panelforge.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    path, parts = f"/root/testdata/sf{sf}", sys.argv[2:]
    spark, con = local_session(8), duck(path)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("SEGMENT_ROWS"):  # force the path of the large keys
        spark.conf.set("panelforge.segmentRows", os.environ["SEGMENT_ROWS"])
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, queries, oracle, path)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.1f}s{'' if name in oracle else ' (rows only)'} {diff or ''}", flush=True)
    print("failed", failed, "of", len(queries))
