"""Result comparison used by the tests and the oracle check script.

Mirrors the driver's gate: same column names, same row count, same
order-insensitive multiset of rows (columns sorted by name).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

from tidewatch.sources.tables import TABLES


def _norm(v, digits: int | None):
    if v is None:
        return None
    if hasattr(v, "asDict"):  # pyspark Row
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x, digits) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows, digits: int | None = None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i], digits) for i in order) for r in rows), key=repr)


def duckdb_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_df, con, sql: str, digits: int = 6) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "schema": sorted(s_cols) == sorted(d_cols)}
    if not out["schema"]:
        out["detail"] = f"spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        out["match"] = False
        return out
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    out["exact"] = a == b
    a6, b6 = rows_of(s_cols, s_rows, digits), rows_of(d_cols, d_rows, digits)
    out["match"] = a6 == b6
    if not out["match"]:
        sa, sb = set(a6), set(b6)
        out["detail"] = f"only_spark={list(sa - sb)[:2]} only_oracle={list(sb - sa)[:2]}"
    return out
