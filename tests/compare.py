"""Exact, order-insensitive comparison of two results, columns matched by name."""

from __future__ import annotations

import math


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return sorted(df.columns), canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return sorted(columns), canonical(columns, cur.fetchall())
