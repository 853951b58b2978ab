"""Local copy of the driver's correctness gate: Spark query vs DuckDB oracle, order-insensitive."""

from __future__ import annotations

import datetime as dt
import math
import sys

import duckdb

SF_SMALL = "/root/testdata/sf0.001"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is __import__("pandas").NA or v is __import__("pandas").NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    out.sort(key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))
    return cols, out


def compare(spark, con, name, fn, sql, sf_dir):
    s = fn(spark, sf_dir).toPandas()
    o = con.execute(sql).fetchdf()
    sc, sr = _rows(s)
    oc, orr = _rows(o)
    msgs = []
    if sc != oc:
        msgs.append(f"columns differ: spark={sc} oracle={oc}")
        return False, msgs
    if len(sr) != len(orr):
        msgs.append(f"row count spark={len(sr)} oracle={len(orr)}")
    bad = 0
    for a, b in zip(sr, orr):
        if a != b:
            bad += 1
            if bad <= 3:
                msgs.append(f"row mismatch:\n  spark ={a}\n  oracle={b}")
    if bad:
        msgs.append(f"{bad} mismatching rows")
    kinds = {c: (s[c].dtype.kind, o[c].dtype.kind) for c in sc}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and not (s[c].isna().all() or o[c].isna().all())}
    if odd:
        msgs.append(f"dtype kinds differ: {odd}")
    return not msgs, msgs


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from aquifer.session import get_spark

    sf_dir = "/root/testdata/sf0.01"
    spark = get_spark()
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    names = argv or sorted(qs)
    ok_n = 0
    for n in names:
        if n not in orc:
            rows = qs[n](spark, sf_dir).count()
            print(f"[rows-only] {n}: {rows} rows")
            continue
        try:
            ok, msgs = compare(spark, con, n, qs[n], orc[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msgs = False, [f"ERROR {type(e).__name__}: {str(e)[:800]}"]
        ok_n += ok
        print(f"[{'OK' if ok else 'FAIL'}] {n}")
        for m in msgs:
            print("   ", m)
    print(f"{ok_n}/{sum(1 for n in names if n in orc)} oracle matches")


if __name__ == "__main__":
    main(sys.argv[1:])
