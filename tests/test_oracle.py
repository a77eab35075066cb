"""Every query with SQL agrees with DuckDB on the smallest tables; the corpus operators have tests of their own."""

import duckdb
import pytest

from tidewatch.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    def plain(v):
        if v is None or v != v:
            return "-"
        return f"{float(v):.4f}" if isinstance(v, int | float) else str(v)

    return sorted(tuple(plain(r[c]) for c in columns) for r in found)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_agrees(spark, duck, name):
    ours = QUERIES[name].run(spark, SF)
    theirs = duck.execute(QUERIES[name].sql)
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.collect(), columns) == rows((dict(zip(columns, r)) for r in theirs.fetchall()), columns)
