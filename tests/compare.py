"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set max_temp_directory_size = '4GB'")  # a statement that needs more is wrong
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return float(f"{float(x):.9g}") if type(x).__name__ == "Decimal" else x


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    a = normal(df.columns, [tuple(r) for r in df.collect()])
    b = normal(*oracle_rows(sql, sf_dir))
    if a[0] != b[0]:
        return [f"columns {a[0]} and {b[0]}"]
    if len(a[1]) != len(b[1]):
        return [f"{len(a[1])} rows and {len(b[1])}"]
    return [f"{x} and {y}" for x, y in zip(a[1], b[1]) if x != y][:3]
