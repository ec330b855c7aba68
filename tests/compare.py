"""Compare queries with their SQL over the given tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def rows_of(frame, cols: list[str]) -> Counter:
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        if isinstance(v, list | tuple):
            return tuple(plain(x) for x in v)
        return float(v) if type(v).__name__ == "Decimal" else v

    return Counter(tuple(plain(v) for v in r) for r in frame)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return [names[i].lower() for i in order], rows_of(([r[i] for i in order] for r in res.fetchall()), names)


def spark_rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns, key=str.lower)
    return [c.lower() for c in cols], rows_of(df.select(*cols).collect(), cols)
