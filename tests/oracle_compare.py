"""Run catalog queries in Spark and their oracle SQL in DuckDB and compare
row count, column names and an order-insensitive value multiset."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime,)):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT",
                 "tinyint": "TINYINT", "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def type_diffs(sdf, con, sql):
    """Columns whose Spark type does not map to the DuckDB result type."""
    duck_types = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        if duck_types.get(f.name) != want:
            out.append((f.name, f.dataType.simpleString(), duck_types.get(f.name)))
    return out


def compare(spark, con, key, qfn, sql, sf_dir):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    info = {"key": key, "cols": ok_cols, "rows": ok_n, "values": ok_v, "n_spark": len(s_rows),
            "n_duck": len(d_rows), "sec": round(t1 - t0, 2)}
    try:
        td = type_diffs(sdf, con, sql)
    except Exception as e:  # DESCRIBE may not support every statement
        td = [("?", repr(e)[:80], "")]
    info["types"] = not td
    if td:
        info["type_diffs"] = td
    if not ok_cols:
        info["spark_cols"] = sorted(s_cols)
        info["duck_cols"] = sorted(d_cols)
    elif not ok_v and ok_n:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        diffs = [(x, y) for x, y in zip(a, b) if x != y]
        info["n_diff"] = len(diffs)
        info["first_diff"] = diffs[:2]
        info["cols_sorted"] = sorted(s_cols)
    return info


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from shelfcast.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2].split(",")) if len(argv) > 2 else None
    spark = build_session()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for k in sorted(qs):
        if only and k not in only:
            continue
        if k not in os_:
            print({"key": k, "oracle": "none"})
            continue
        try:
            info = compare(spark, con, k, qs[k], os_[k], sf_dir)
        except Exception as e:  # report and continue
            info = {"key": k, "error": repr(e)[:600]}
        if not info.get("values"):
            bad += 1
        print(info, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv)
