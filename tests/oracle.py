"""Rows of a query and of its SQL, in a form that can be compared."""

import decimal
import math
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, con, sql):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
