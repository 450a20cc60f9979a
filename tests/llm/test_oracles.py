import duckdb
import pytest

from loomspan.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(q.oracle_sql()[name])
    names = sorted(want.columns)
    got = q.queries()[name](spark, SF).select(*[f"`{n}`" for n in names])
    row = lambda r: tuple(round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    assert sorted(map(row, got.collect()), key=str) == sorted(map(row, want.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=str)
