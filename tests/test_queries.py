"""Every registered query beside its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle.query_sql import ORACLE
from textguard.plans.queries import QUERIES
from tests.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["request_id", "masked_text", "detection_count", "token_count",
                           "detection_types"]
    assert got.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    columns, got = spark_rows(QUERIES[name](spark, SF))
    wanted_columns, wanted = sql_rows(db, ORACLE[name])
    assert columns == wanted_columns
    assert got == wanted
