"""Every query with SQL returns DuckDB's rows."""

import duckdb
import pytest

from postledger.plans import catalog as queries

SF = "/root/testdata/sf0.001"


def _norm(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 6)
        return float(v) if type(v).__name__ == "Decimal" else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert _norm(map(tuple, got.select(*cols).collect())) == _norm([tuple(r[i] for i in at) for r in want.fetchall()])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
