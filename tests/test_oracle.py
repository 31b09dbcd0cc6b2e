"""Every registered query equals its oracle SQL on the smallest data folder."""

import pytest

import __spark_entry__ as entry  # noqa: I001
from check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    build, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert build(spark, FOLDER).columns
        return
    assert compare(spark, con, FOLDER, name, build, sql) is None


def test_every_query_has_survey_ids_and_oracle():
    from verdictlake.plans import catalog

    assert set(catalog.SURVEY_IDS) == set(catalog.QUERIES)
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "hallucination_rate" in df.columns
