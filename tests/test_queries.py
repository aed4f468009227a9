"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) == ""


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() == 40


@pytest.mark.parametrize("name", ["d15_corpus_bleu", "e1_assign_batches", "f8_show_alternatives", "c5_interpolate", "e7_running_loss_log"])
def test_results_do_not_depend_on_partitions(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert compare(entry_points.queries()[name](spark, SF), con, entry_points.oracle_sql()[name]) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
