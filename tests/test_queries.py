import pytest
from oracle import same

from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lsh_finds_the_vector_itself(spark, sf_dir):
    rows = registry.queries()["lsh_knn"](spark, sf_dir).collect()
    assert rows and rows[0]["id"] == "mem_00000000" and rows[0]["distance"] == 0.0
