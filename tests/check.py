"""Run registered queries against their SQL on one scale; `python tests/check.py sf0.01 [prefix ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = Path("/root/testdata")


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(pdf):
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        s = pdf[c]
        if str(s.dtype).startswith("datetime"):
            pdf[c] = pd.to_datetime(s).astype("datetime64[us]").astype(str)
        elif s.dtype == object or str(s.dtype).startswith(("str", "string")):
            pdf[c] = s.map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(v))
        else:
            pdf[c] = s.astype("float64")
    rows = [tuple("~" if (v is None or v != v) else (repr(v + 0.0) if isinstance(v, float) else v) for v in r)
            for r in pdf.itertuples(index=False)]
    return sorted(rows)


def compare(spark, con, name, fn, sql, sf_dir):
    got = fn(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    a, b = canon(got), canon(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cols = sorted(got.columns)
        diff = {c: (p, q) for c, p, q in zip(cols, x, y) if p != q}
        return f"{len(bad)} differing rows, first: {diff} in {x[:4]}", len(got)
    kinds = []
    for c in got.columns:
        g, w = str(got[c].dtype), str(want[c].dtype)
        if g != w and not (g.startswith("datetime") and w.startswith("datetime")) and {g, w} != {"object", "str"}:
            kinds.append(f"{c}:{g}/{w}")
    return ("ok" + (" types " + ",".join(kinds) if kinds else "")), len(got)


def main(argv):
    from breezeframe.catalog import load_all
    from breezeframe.session import build_session

    sf_dir = str(DATA / argv[0])
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load_all()
    names = [n for n in queries if len(argv) == 1 or any(n.startswith(p) for p in argv[1:])]
    con = duck(sf_dir)
    failed = 0
    for n in names:
        t = time.time()
        try:
            if n in oracles:
                msg, rows = compare(spark, con, n, queries[n], oracles[n], sf_dir)
            else:
                rows = queries[n](spark, sf_dir).toPandas().shape[0]
                msg = "ok (rows only)"
        except Exception as e:  # noqa: BLE001
            msg, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += not msg.startswith("ok")
        print(f"{n:34s} {rows:8d} {time.time() - t:6.1f}s {msg}", flush=True)
    print("FAILED" if failed else "ALL OK", failed, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
