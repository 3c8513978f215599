"""Compare queries with their SQL on the driver's tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, missing values alike, doubles exact."""
    value = lambda x: None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


def differences(spark, query, sql: str, sf_dir: str = DATA) -> list[str]:
    ours, theirs = query(spark, sf_dir), connection(sf_dir).sql(sql)
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"]
    a, b = rows(pd.DataFrame(ours.collect(), columns=ours.columns)), rows(theirs.df())
    return [] if a == b else [f"{len(a)} and {len(b)} rows", *(f"{x} | {y}" for x, y in zip(a, b) if x != y)][:4]
