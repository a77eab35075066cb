"""The corpus operators that have SQL agree with DuckDB on the smallest tables."""

import duckdb
import pytest

from tidewatch.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(found, columns):
    def plain(v):
        return "-" if v is None else f"{float(v):.6f}" if isinstance(v, int | float) else str(v)

    return sorted(tuple(plain(r[c]) for c in columns) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.collect(), columns) == rows((dict(zip(columns, r)) for r in theirs.fetchall()), columns)
