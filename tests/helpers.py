"""Rows of two engines side by side."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or not isinstance(value, int):
        return value
    return float(value) if abs(value) < 1 << 53 else value


def same(df, sql: str, sf_dir: str) -> None:
    names, want = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert len(got) == len(want)
    assert got == want
