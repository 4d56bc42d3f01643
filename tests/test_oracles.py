"""Every registered query against its oracle SQL on the smallest data."""

import compare
import pytest

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return compare.connection(data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(entry_module.LLM_QUERIES)))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        found = [d for d in compare.differences(df, con, ORACLES[name]) if not d.startswith("note")]
        assert not found, "\n".join(found)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_but_fingerprints_has_an_oracle():
    # The training-data queries have tests of their own.
    places = {name for name in QUERIES if not name.startswith("op") and name != "pipeline"}
    assert places - set(ORACLES) == {"s10_fingerprints"}


def test_nearest_open_reaches_the_largest_radius(spark, data):
    far = QUERIES["w5_nearest_open_far"](spark, data).groupBy("query_id").count().collect()
    near = QUERIES["w5_nearest_open_default"](spark, data).groupBy("query_id").count().collect()
    assert sum(r["count"] for r in far) > sum(r["count"] for r in near)
    assert QUERIES["w5_nearest_open_far"](spark, data).where("distance_m > 1000").count() > 0
