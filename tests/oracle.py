"""Compare a query with its DuckDB twin, ignoring row and column order."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if hasattr(v, "as_tuple"):  # decimals of DuckDB sums
        return int(v) if v == v.to_integral_value() else float(v)
    return v


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
