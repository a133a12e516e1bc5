"""Every query of the engine against its SQL, over whole tables."""

import pytest
from compare import same

from palimpsest.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    same(df, Q.oracle_sql()[name], SF)
    assert df.limit(1).count() == 1  # two empty results would agree as well


@pytest.mark.parametrize("name", ["get_current", "get_as_of", "find_where_str", "find_bool", "find_neq_replay", "related_out", "related_as_of", "edge_types", "search", "put_delete_find", "relate_unrelate", "restored_find"])
def test_picks_decide(spark, monkeypatch, name):
    """Without its pick of versions a query gives other rows."""
    from palimpsest.operators import versions

    monkeypatch.setattr(versions, "_pick", lambda log, by: log)
    df = Q.queries()[name](spark, SF)
    with pytest.raises(AssertionError):
        same(df, Q.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns[:3] == ["collection", "key", "value"]
    assert found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_value_conditions_stay_above_the_pick(spark):
    """A condition on values that ran below the pick would bring back old versions."""
    plan = Q.queries()["find_as_of_where"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("try_variant_get") < plan.index("max_by")


def test_time_reaches_the_scan(spark):
    from palimpsest.operators import versions
    from palimpsest.plans import tables

    log = tables.users(spark, SF)
    plan = versions.visible(log, as_of="2024-01-10")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(ts" in plan
