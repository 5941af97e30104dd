"""Runs a query on Spark and its SQL on DuckDB and compares rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 4)
    return x


def rows_of(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(tuple(_plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in cur.fetchall())
