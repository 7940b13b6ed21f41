"""Run a registered query and its SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v) if isinstance(v, int) else str(v)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    rel = con.sql(sql)
    cols = list(rel.columns)
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    if sorted(got) == sorted(want):
        return "" if got else "no rows"
    only_got, only_want = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return f"{len(got)} rows != {len(want)}; {names}; only spark {only_got}; only sql {only_want}"


if __name__ == "__main__":
    from tariffloom.session import local_session
    from tariffloom.workloads import all_workloads

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    for w in all_workloads().values():
        if wanted and not any(w.name.startswith(p) for p in wanted):
            continue
        t = time.time()
        try:
            df = w.build(spark, sf)
            if w.sql is None:
                n = df.count()
                print(f"rows {w.name:32} {n:8} {time.time() - t:6.2f}s", flush=True)
                continue
            diff = compare(df, con, w.sql)
        except Exception as error:  # noqa: BLE001
            diff = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if not diff else 'FAIL'} {w.name:32} {time.time() - t:6.2f}s {diff[:1500]}", flush=True)
