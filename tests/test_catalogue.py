import pytest

from sigloom.plans import catalogue
from tests.compare import duck, same

ORACLE = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, sf_dir, name):
    same(catalogue.queries()[name](spark, sf_dir).toPandas(), duck(sf_dir).sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLE)))
def test_has_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
