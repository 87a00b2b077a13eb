"""Every query against the same query in the other engine."""

import pytest

from gridmill.plans import queries as Q

from .conftest import SF, rows


@pytest.mark.parametrize("name", list(Q.SQL))
def test_equal(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(Q.SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["product_gap_fill", "product_blend", "product_blend_all", "raster_logic"])
def test_statistics_once(spark, name):
    """Points are sorted into cells once, not for each use of the statistics."""
    assert "l_partkey" not in Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
