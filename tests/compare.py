"""Rows of Spark and DuckDB in one canonical form."""

import decimal
import math

import numpy as np


def canon(v):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        return "NaN" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(canon(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    return cols, sorted((tuple(canon(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
