"""Queries over names that are made from keys, on keys that the small tables don't have."""

import duckdb
import pytest

from redsieve.plans import cases, queries, sql

QUERIES, ORACLES = queries.queries() | cases.queries(), sql.ORACLES | cases.SQL
#: In letters they hold the word "aged".
KEYS = (10643, 106431, 106438, 30643)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("keys"))
    spark.createDataFrame([(k, k % 25) for k in (*KEYS, 1, 2, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(k, k % 25) for k in (*KEYS, 1, 2, 3)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return folder


def same_rows(spark, folder, name):
    con = duckdb.connect()
    for table in ("customer", "supplier"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    found = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(found)


def test_a_role_within_a_name_is_none(spark, tables):
    same_rows(spark, tables, "harvest_short_block")


def test_a_header_whose_name_holds_a_role_is_a_label(spark, tables):
    same_rows(spark, tables, "header_guard")


def test_a_name_that_holds_a_role_is_no_context(spark, tables):
    same_rows(spark, tables, "propagate_by_words")
