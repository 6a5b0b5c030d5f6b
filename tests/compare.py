"""Run registered queries beside their SQL and compare rows as multisets."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("n", "")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return ("f", round(float(v), 6) + 0.0)
    return ("s", str(v))


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def difference(spark_side, duck_side):
    (sn, sr), (dn, dr) = spark_side, duck_side
    if sn != dn:
        return f"columns {sn} != {dn}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}; first {sr[:2]} / {dr[:2]}"
    for a, b in zip(sr, dr):
        if a != b:
            return f"row {a} != {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from propweave.session import get_session

    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            t0 = time.time()
            got = spark_table(fn(spark, sf_dir))
            t1 = time.time()
            diff = difference(got, duck_table(con, oracle[name])) if name in oracle else None
            t2 = time.time()
            state = "FAIL " + diff[:600] if diff else ("ok" if name in oracle else "rows")
            bad += bool(diff)
            print(f"{name:28s} rows={len(got[1]):7d} spark={t1 - t0:6.2f}s duck={t2 - t1:6.2f}s {state}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__} {str(e)[:700]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
