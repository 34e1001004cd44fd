import pytest
from compare import assert_same, connection

from curator import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLES:
        assert_same(df, plans.ORACLES[name], con)
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_edition_run_reads_all_reviews_and_all_items(spark, sf_dir):
    reviewed = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").collect()}
    queued = {r.id for r in plans.QUERIES["edition_run"](spark, sf_dir).where("edition IS NOT NULL").collect()}
    assert not queued & reviewed  # a reviewed title with keywords is like itself
    assert any(i % 9 == 0 for i in queued)
