"""Every registered query against its SQL on the test tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import TESTDATA, plan_of

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    yield con
    con.close()


def table(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in records)


def test_every_query_has_a_row_check():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", contract.queries())
def test_query(spark, oracle, name):
    df = contract.queries()[name](spark, TESTDATA)
    records = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert records
        return
    result = oracle.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    assert table(df.columns, records) == table(list(described), expected)


def test_no_sketch_for_every_distinct_key(spark, tmp_path):
    made = [(i % 50 or None, i % 7 or None) for i in range(200)]
    spark.createDataFrame(made, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    df = contract.queries()["agg_approx_distinct"](spark, str(tmp_path))
    assert tuple(df.first()) == (49, 6, True, True)
    # An aggregate that has keys holds no sketch.
    assert "approx_count_distinct" in plan_of(df)
    assert not re.search(r"keys=\[[^\]]+\], functions=[^\n]*approx_count_distinct", plan_of(df))
