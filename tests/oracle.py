"""Run a query and its SQL side by side: columns by name, rows as a multiset."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if hasattr(x, "as_tuple"):
        return round(float(x), 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(row[i]) for i in order) for row in rows)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    return rows_of([c[0] for c in cur.description], cur.fetchall())


def compare(df, sql, sf_dir):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = oracle_rows(sql, sf_dir)
    assert got[0] == want[0], (got[0], want[0])
    extra, lacking = got[1] - want[1], want[1] - got[1]
    assert not extra and not lacking, (sum(extra.values()), sum(lacking.values()), list(extra)[:3], list(lacking)[:3])
    return sum(got[1].values())
