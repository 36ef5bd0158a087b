"""Run registered queries beside their SQL and compare, as the driver does.

python tests/oracle_check.py [--sf 0.01] [--cpus 8] [name ...]
"""

import argparse
import math
import sys
import time
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None or v is pd.NA or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "tolist"):
        return str(v.tolist())
    return v if isinstance(v, (int, bool)) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(norm(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


def compare(spark, con, sf_dir, name, show=True):
    t = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.toPandas()
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got), took, 0.0
    t = time.time()
    want = con.execute(sql).df()
    sql_took = time.time() - t
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(set(got.columns) ^ set(want.columns))}", len(got), took, sql_took
    a, b = rows(got), rows(want)
    if a == b:
        types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
        note = "" if not types else f" types {types}"
        return "ok" + note, len(got), took, sql_took
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if show:
        print("   cols", sorted(got.columns))
        for x, y in diff[:3]:
            print("   got ", x)
            print("   want", y)
    return f"DIFF {len(diff)} rows, {len(a)} vs {len(b)}", len(got), took, sql_took


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--cpus", default="8")
    p.add_argument("--prefix", default="")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    import duckdb

    from tidemark.session import local_session

    sf_dir = f"/root/testdata/sf{a.sf}"
    spark = local_session(a.cpus)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in a.names or [n for n in entry.queries() if n.startswith(a.prefix)]:
        try:
            status, n, took, sql_took = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            if a.names:
                import traceback

                traceback.print_exc()
            status, n, took, sql_took = f"ERROR {type(e).__name__}: {str(e)[:900]}", 0, 0.0, 0.0
        bad += not status.startswith(("ok", "rows-only"))
        print(f"{name:32s} {n:8d} rows  spark {took:6.2f}s  sql {sql_took:6.2f}s  {status}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
