"""Run registered queries in Spark and their SQL in DuckDB; compare names, row counts and values.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    import numpy as np
    import pandas as pd
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.floating, float)):
        f = float(v)
        if math.isnan(f):
            return None
        return int(f) if f.is_integer() and abs(f) < 2 ** 53 else round(f, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (np.bool_, bool)):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return v


# Spark type name -> DuckDB type name the oracle should produce
TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT"}


def type_mismatches(sdf_schema, con, sql):
    rel = con.sql(sql)
    duck_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    out = []
    for f in sdf_schema.fields:
        want = TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
        got = duck_types.get(f.name)
        if got is not None and got != want:
            out.append(f"{f.name}: spark {f.dataType.simpleString()} vs sql {got}")
    return out


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir, names=None, con=None, verbose=True):
    from basin.plans.queries import ORACLE, QUERIES
    from basin.plans import io_queries  # noqa: F401
    con = con or duck(sf_dir)
    results = {}
    for name in (names or list(QUERIES)):
        t0 = time.time()
        try:
            sframe = QUERIES[name](spark, sf_dir)
            sdf = sframe.toPandas()
        except Exception as e:  # report and go on
            results[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} SPARK ERROR {str(e)[:400]}")
            continue
        t1 = time.time()
        if name not in ORACLE:
            results[name] = ("rows-only", len(sdf))
            if verbose:
                print(f"{name:28s} rows-only {len(sdf)} rows  spark {t1 - t0:.1f}s")
            continue
        try:
            ddf = con.execute(ORACLE[name]).df()
        except Exception as e:
            results[name] = ("sql-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} SQL ERROR {str(e)[:400]}")
            continue
        sc, sr = rows_of(sdf)
        dc, dr = rows_of(ddf)
        types = type_mismatches(sframe.schema, con, ORACLE[name])
        if sc != dc:
            status = ("names", f"spark {sc} vs sql {dc}")
        elif len(sr) != len(dr):
            status = ("count", f"spark {len(sr)} vs sql {len(dr)}")
        elif sr != dr:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            status = ("values", f"first diffs {diff}")
        elif types:
            status = ("types", "; ".join(types))
        else:
            status = ("ok", len(sr))
        results[name] = status
        if verbose:
            print(f"{name:28s} {status[0]:8s} {str(status[1])[:600]}  spark {t1 - t0:.1f}s")
    return results


if __name__ == "__main__":
    from basin.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok; bad: {sorted(bad)}")
