"""Compares a query's rows with its SQL's, whatever their order."""

import decimal


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, duck, sql):
    r = duck.sql(sql)
    names = sorted(r.columns)
    assert names == sorted(df.columns)
    at = [r.columns.index(n) for n in names]
    want = sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
    got = sorted(repr(tuple(plain(x[n]) for n in names)) for x in df.collect())
    assert len(got) == len(want)
    assert got == want
