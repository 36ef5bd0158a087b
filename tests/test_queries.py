"""A few registered queries against their SQL on the smallest tables; the full set runs in oracle_check.py."""

import duckdb
import pytest

from tests.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = ["theme_strength", "session_returns", "day_result", "usage_changes", "canonical_url", "parse_price_payload"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name)[0].startswith("ok")


def test_every_query_is_callable_and_named_once():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130
