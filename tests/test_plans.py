"""Each query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from framewright import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return db


def plain(x):
    return "null" if x is None or x != x else repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    out = plans.queries()[name](spark, DATA)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(out.columns)
    have = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    assert have == sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert have
