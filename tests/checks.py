from __future__ import annotations

import os

DATA = "/root/testdata/sf0.001"


def same_rows(spark, sf_dir: str, query, sql: str) -> None:
    """The query's rows are those of its SQL in DuckDB, whatever their order."""
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    found = db.sql(sql)
    assert sorted(found.columns) == names
    theirs = sorted(map(repr, found.select(*(f'"{n}"' for n in names)).fetchall()))
    assert ours == theirs
