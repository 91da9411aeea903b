"""The queries run on the smallest tables; SQL where there is any."""

from pathlib import Path

import duckdb
import pytest

from utterlake.llm.queries import oracle_sql, queries

COLUMNS = {"p1_found": ["take_id"], "p2_found": ["doc_id", "item_id"], "p3_found": ["id_a", "id_b"], "p4_found": ["id"], "p5_found": ["source_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, folder, name):
    df = queries()[name](spark, folder)
    got = df.toPandas()
    assert len(got) == len(got.drop_duplicates())
    if name in COLUMNS:
        assert list(got.columns) == COLUMNS[name]
    if name in oracle_sql():
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert sorted(map(tuple, con.execute(oracle_sql()[name]).fetchall())) == sorted(map(tuple, got.values.tolist()))
