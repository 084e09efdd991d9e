"""Runs registered queries next to their SQL in DuckDB and compares the rows."""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def compare(spark, con, folder: str, name: str) -> str:
    from spatialqa.registry import ORACLES, QUERIES
    start = time.time()
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    took = time.time() - start
    if name not in ORACLES:
        return f"rows {len(rows)} ({took:.1f}s)"
    start = time.time()
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    same = {"long": ("BIGINT", "NUMBER"), "double": ("DOUBLE", "NUMBER"), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "bool")}
    odd = [(n, kinds[n], types[n]) for n in names if kinds[n] in same and types[n] not in same[kinds[n]]]
    order = sorted(names)
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    got = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=key)
    place = [names.index(c) for c in order]
    exp = sorted((tuple(norm(r[i]) for i in place) for r in want), key=key)
    if got == exp:
        return f"ok {len(got)} ({took:.1f}s / {duck_took:.1f}s)" + (f" TYPES {odd}" if odd else "")
    only_g = [g for g in got if g not in set(exp)][:3] if len(got) < 200000 else []
    only_e = [e for e in exp if e not in set(got)][:3] if len(exp) < 200000 else []
    return f"FAIL {len(got)} vs {len(exp)} {order} spark-only {only_g} sql-only {only_e}"


if __name__ == "__main__":
    from spatialqa.registry import QUERIES
    from spatialqa.session import local_session
    folder = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), duck(folder)
    for name in names:
        try:
            print(f"{name:26s}", compare(spark, con, folder, name), flush=True)
        except Exception as error:
            print(f"{name:26s} ERROR", type(error).__name__, str(error)[:900].replace("\n", " | "), flush=True)
