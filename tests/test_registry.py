import pytest

from cloudloom.operators import sampling
from cloudloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(name, spark, sf, same_as_sql):
    same_as_sql(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["idx", "rgb"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["lod_levels", "lod_color_join"])
def test_levels_hold_all_rows_beyond_the_display_limit(name, spark, sf, same_as_sql, monkeypatch):
    monkeypatch.setattr(sampling.base_cache, "__defaults__", (1.0, 100, "head"))
    same_as_sql(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name])
