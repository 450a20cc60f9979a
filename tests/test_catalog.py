"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from loomspan import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    def cell(v):
        if v is None or v != v:
            return None
        return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got)


def test_all_names_are_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def join_rows(plan):
    """Rows that each join of an executed plan gave out."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return join_rows(plan.executedPlan())
    if "QueryStage" in plan.getClass().getSimpleName():
        return join_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for k in range(plan.children().size()) for n in join_rows(plan.children().apply(k))]


def test_mention_candidates_never_pairs_mentions_with_candidates(spark, tmp_path):
    """A name of 2,000 entities in 3,000 articles; besides, null and repeated keys, a null name and a name without uses."""
    part = [(k, "same") for k in range(2000)] + [(2000, "rare"), (2000, "rare"), (2001, None), (2002, "unused"), (None, "same"), (2003, "same"), (2003, "rare")]
    orders = [(k, k % 2000) for k in range(3000)] + [(1, 2000), (1, 2000), (3000, 2001), (3001, 2002), (3002, None), (None, 5), (None, 2003), (3003, 9999)]
    lines = [(k, k % 2000, 1) for k in range(5000)] + [(1, 2000, 2), (2, 2001, 1), (3, None, 1), (4, 2003, 1), (4, 2003, 2)]
    spark.createDataFrame(part, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES["mention_candidates"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(con.sql(catalog.ORACLE_SQL["mention_candidates"]).fetchall(), key=str)
    assert df.dtypes == [("article_id", "bigint"), ("n_candidates", "bigint"), ("best", "bigint")]
    joins = join_rows(df._jdf.queryExecution().executedPlan())
    assert joins and max(joins) <= len(orders) + len(lines)
