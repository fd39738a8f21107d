"""Compare a query's rows with those of its SQL, as multisets."""

import math

import numpy as np


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple, np.ndarray)) and not hasattr(v, "asDict"):
        return tuple(map(canon, v))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, canon(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((canon(k), canon(x)) for k, x in v.items()))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(map(canon, r))) for r in df.select(*[df[c] for c in cols]).collect())


def rows_of_sql(duck, sql, columns):
    rel = duck.sql(sql)
    assert sorted(rel.columns) == sorted(columns)
    at = [rel.columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(canon(r[i]) for i in at)) for r in rel.fetchall())
