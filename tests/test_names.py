import pytest

from tidemill.functions.names import snake_case, unique_names
from tidemill.plans.staging import cast_rejects, clean_names, stage_columns, stage_names, staging_select, strip_prefix
from tidemill.sources.catalog import Layers


@pytest.mark.parametrize(
    "given, clean",
    [
        ("Body mass (g)", "body_mass_g"),
        ("Max longevity (yrs)", "max_longevity_yrs"),
        ("HAGRID", "hagrid"),
        ("weird/name-here", "weird_name_here"),
        ("123abc", "c_123abc"),
        ("order", "order_"),
        ("", "col"),
        ("  __a  b__ ", "a_b"),
        ("%", "col"),
    ],
)
def test_snake_case(given, clean):
    assert snake_case(given) == clean


@pytest.mark.parametrize(
    "given, unique",
    [
        (["a", "a", "a", "b"], ["a", "a_1", "a_2", "b"]),
        (["a", "a", "a_1"], ["a", "a_2", "a_1"]),
        (["a", "A"], ["a", "A_1"]),
        ([], []),
    ],
)
def test_unique_names(given, unique):
    assert unique_names(given) == unique


def test_staging_keeps_rows_and_order_of_columns(spark):
    raw = spark.createDataFrame([(1, "x", 2.0)], "`Body mass (g)` int, `a.b` string, Order double")
    staged = stage_names(raw)
    assert staged.columns == ["body_mass_g", "a_b", "order_"]
    assert staged.collect() == raw.toDF(*staged.columns).collect()


def test_staging_select_is_the_same_rename(spark):
    spark.createDataFrame([(1, 2)], "`Body {mass}` int, `a``b` int").createOrReplaceTempView("raw_names")
    sql = staging_select(spark.table("raw_names").columns, "raw_names").format()
    assert spark.sql(sql).columns == clean_names(["Body {mass}", "a`b"])


def test_curated_staging_casts_and_drops_junk(spark):
    raw = spark.createDataFrame([("1", "k"), ("x", "k"), ("2", None)], "ID string, Kingdom string")
    names, casts = {"ID": "id", "Kingdom": "kingdom"}, {"id": "int"}
    staged = stage_columns(raw, names, casts, required=["id", "kingdom"], lenient=["id"])
    assert staged.dtypes == [("id", "int"), ("kingdom", "string")]
    assert [tuple(r) for r in staged.collect()] == [(1, "k")]
    assert [tuple(r) for r in cast_rejects(raw, names, casts).collect()] == [("x", "k", ["id"])]


def test_a_value_that_does_not_fit_ends_the_job(spark):
    raw = spark.createDataFrame([(3_000_000_000,)], "ID long")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        stage_columns(raw, {"ID": "id"}, {"id": "int"}, required=["id"]).collect()


def test_strip_prefix(spark):
    df = spark.createDataFrame([(1, 2, "n")], "c_custkey int, c_nation_key int, c_name string")
    assert strip_prefix(df, "c_").columns == ["cust_key", "nation_key", "name"]


@pytest.mark.parametrize("name", ["../x", "", "a b", "a" * 65, "_x"])
def test_bad_dataset_names_are_refused(name):
    with pytest.raises(ValueError):
        Layers(name)


def test_layer_names():
    assert Layers("My-data_1").databases == ("My_data_1_raw", "My_data_1_staging", "My_data_1_marts")
