"""Compares a query with its DuckDB SQL over a folder of tables."""

import os
from decimal import Decimal

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, Decimal)) else value


def same(p, q):
    number = (int, float)
    return p == q or isinstance(p, number) and isinstance(q, number) and not isinstance(p, bool) and abs(p - q) <= 1e-5 * max(1, abs(p))


def differences(spark, con, query, sql, folder):
    """Column names that differ, or the first differing rows, or nothing."""
    relation, frame = con.sql(sql), query(spark, folder)
    if sorted(relation.columns) != sorted(frame.columns):
        return sorted(set(relation.columns) ^ set(frame.columns))
    order = sorted(relation.columns)
    rows = []
    for columns, found in ((relation.columns, relation.fetchall()), (frame.columns, map(tuple, frame.collect()))):
        at = [columns.index(c) for c in order]
        rows.append(sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr))
    if len(rows[0]) != len(rows[1]):
        return [len(rows[0]), len(rows[1])]
    return [(a, b) for a, b in zip(*rows, strict=True) if not all(map(same, a, b))][:2]
