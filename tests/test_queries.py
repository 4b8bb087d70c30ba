"""Every registered query: against its SQL where it has some, else that it gives rows, twice the same, whatever the number of partitions."""

import pytest

from reeltable.jobs import registry
from tests.compare import DATA, connect, rows, same

STREAMS = sorted(n for n in registry.QUERIES if n.startswith("stream_"))


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    same(registry.QUERIES[name](spark, DATA), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - set(STREAMS)))
def test_gives_rows_whatever_the_partitions(spark, name):
    first = rows(registry.QUERIES[name](spark, DATA).collect())
    assert first
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(registry.QUERIES[name](spark, DATA).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["stream_id", "frame_id", "json"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
