"""Every registered query against the independent SQL, and that none of them is vacuous.

The queries share the parsed tables of the session.
"""

import pytest

import __spark_entry__ as entry
from leadloom.plans.queries import QUERIES
from oracle import compare


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, folder, con, name):
    assert compare.differences(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name]) == []


def test_every_rule_fires_at_sf001():
    con = compare.connect("/root/testdata/sf0.01")
    for name, sql in entry.oracle_sql().items():
        if name in QUERIES and name.startswith("r"):
            assert len(con.execute(sql).fetchall()) > 0, name


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].opportunity_score >= rows[-1].opportunity_score
