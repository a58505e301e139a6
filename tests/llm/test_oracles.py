"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from chorale.llm import catalog
from odd_rows import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    import check
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, _ = check.canon(catalog.QUERIES[name](spark, SF).toPandas())
    want, _ = check.canon(con.execute(catalog.ORACLES[name]).fetchdf())
    assert got == want and got


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
