"""Rows of a Spark DataFrame and of DuckDB SQL, comparable."""

from __future__ import annotations

import os

import duckdb


def rows(table) -> list[tuple]:
    """Rows of an Arrow table, columns by name, as sorted text."""
    names = sorted(table.column_names)
    out = [tuple("null" if r[n] is None else repr(round(r[n], 6)) if isinstance(r[n], float) else str(r[n]) for n in names) for r in table.to_pylist()]
    return sorted(out)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con.sql(sql).to_arrow_table()


def assert_same(df, sql: str, sf_dir: str) -> None:
    got, want = df.toArrow(), oracle(sql, sf_dir)
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
