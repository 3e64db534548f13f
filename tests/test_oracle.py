"""Every query with checking SQL gives the same rows, names and types."""

import pytest
from compare import connect, differences

from amperic.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    rows, wrong = differences(df, con, ORACLES[name])
    assert not wrong
    assert rows > 0


def test_counts_of_the_views(spark, sf_dir):
    """Counts known for the outage rule on this scale."""
    if not sf_dir.endswith("sf0.01"):
        pytest.skip("known for one scale only")
    got = QUERIES["outage_transitions"](spark, sf_dir).selectExpr("count(*)", "sum(event_id)").first()
    assert tuple(got) == (578, 2947802)
