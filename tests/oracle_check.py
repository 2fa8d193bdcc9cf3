"""Side-by-side check of registered queries against their DuckDB oracle,
comparing like the driver: row count, column names, and an order-insensitive
hash of the values with columns sorted by name.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
                 "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT"}


def _duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return _duck_type(spark_type[6:-1]) + "[]"
    return SPARK_TO_DUCK.get(spark_type, spark_type.upper())


def compare(spark, sf_dir, names=None, verbose=True, strict_types=True):
    from __spark_entry__ import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        if name not in sqls:
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            rel = con.sql(sqls[name])
            dcols = rel.columns
            dtypes = [str(t) for t in rel.types]
            drows = rel.fetchall()
            stypes = [_duck_type(f.dataType.simpleString()) for f in df.schema.fields]
        except Exception as e:  # noqa: BLE001
            results[name] = f"ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        sc, sr = canon(scols, srows)
        dc, dr = canon(dcols, drows)
        types_ok = (not strict_types) or \
            sorted(zip(scols, stypes)) == sorted(zip(dcols, dtypes))
        ok = sc == dc and len(sr) == len(dr) and sr == dr and types_ok
        msg = "OK" if ok else "MISMATCH"
        if not types_ok:
            msg += f" types {sorted(zip(scols, stypes))} vs {sorted(zip(dcols, dtypes))}"
        if not ok:
            msg += f" cols {sc} vs {dc}; rows {len(sr)} vs {len(dr)}"
            diff = [r for r in sr if r not in set(dr)][:3]
            diff2 = [r for r in dr if r not in set(sr)][:3]
            msg += f"; spark-only {diff}; duck-only {diff2}"
        results[name] = msg
        if verbose:
            print(f"{name}: {msg} ({len(sr)} rows, {time.time() - t0:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    from homecast.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v != "OK"}
    print(f"{len(res) - len(bad)}/{len(res)} OK")
