"""Every checked query against its SQL, and the driver contract."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from paritas.checks.oracle import ORACLE
from paritas.checks.queries import QUERIES
from tools.compare import differences, register_views


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    register_views(con, small)
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, small, name):
    outcome, _ = differences(spark, duck, small, name)
    assert outcome.startswith("equal"), outcome


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_a_folder_of_the_session_is_kept(spark, small):
    before = spark.conf.get("spark.checkpoint.dir")
    queries()["split_counts"](spark, small)
    assert spark.conf.get("spark.checkpoint.dir") == before


def test_entry_has_a_row_per_model_and_identity(spark):
    df = entry(spark)
    assert df.columns[:4] == ["dataset", "model", "ord", "identity"]
    assert df.count() == 4 * 24
