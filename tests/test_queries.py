import duckdb
import pytest

from gasframe import queries, queries_more

QUERIES, ORACLES = {**queries.QUERIES, **queries_more.QUERIES}, {**queries.ORACLES, **queries_more.ORACLES}
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = db.sql(ORACLES[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert len(a) == len(b) and all((a[c].fillna(-9) == b[c].fillna(-9)).all() for c in cols)
