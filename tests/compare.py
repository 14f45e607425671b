"""Spark results against DuckDB's, row for row, whatever their order."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return names, r.fetchall()


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def same(names_a, rows_a, names_b, rows_b) -> str:
    if sorted(names_a) != sorted(names_b):
        return f"columns {sorted(names_a)} and {sorted(names_b)}"
    at_a, at_b = ([n.index(c) for c in sorted(n)] for n in (names_a, names_b))
    key = lambda r: tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in r)
    a, b = sorted(([plain(r[i]) for i in at_a] for r in rows_a), key=key), sorted(([plain(r[i]) for i in at_b] for r in rows_b), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else ""
