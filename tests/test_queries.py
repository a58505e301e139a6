"""The catalogue on the smallest tables: every key runs, a few heavy ones against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

SAMPLE = ["J5_per_species_table", "P6_muddiness", "K17_summary", "V13_sweep", "X7_navigator_bins", "E8_recall_table", "L9_accumulation", "A21_bundle_candidates"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200 and len(o) > 0.95 * len(q)


def test_oracles_parse_without_spark(con):
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    import check
    got, _ = check.canon(entry.queries()[name](spark, SF).toPandas())
    want, _ = check.canon(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert got == want
