"""Every core query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from utterlake.plans.oracle import oracle_sql
from utterlake.plans.queries import QUERIES

SQL = oracle_sql()


def rows(frame):
    def one(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name in SQL:
        want = db.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
