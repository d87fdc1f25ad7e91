"""Every query with SQL against DuckDB on the driver's smallest tables."""

import duckdb
import pytest

from selenite.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, repr(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    rel = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert ordered(got) == ordered(tuple(r[i] for i in place) for r in rel.fetchall())
