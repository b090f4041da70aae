import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators.checks import suggest_checks
from tidemill.operators.profiling import (
    GROUNDING_OPTIONS,
    ProfileOptions,
    candidate_keys,
    exact_distincts,
    grain,
    profile_columns,
    profile_many_columns,
    profile_table,
    profile_tables,
    sample_values,
    ground,
    schema_summary,
)
from tidemill.operators.relationships import infer_relationships, infer_relationships_by_grain

from conftest import rows


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_keys(spark):
    df = spark.createDataFrame([(1, "Olm", "Amphibia"), (2, "Mouse", "Mammalia"), (3, "Rat", "Mammalia")], "id int, species string, class string")
    found = {r["name"] for r in candidate_keys(profile_columns(df, "t")).collect()}
    assert "id" in found and "class" not in found


def test_null_rate_is_rounded(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, None)], "a int, b string")
    b = by_name(profile_table(df))["b"]
    assert (b["null_count"], b["null_rate"], b["exact_distinct"], b["is_candidate_key"]) == (2, 0.6667, None, False)
    assert by_name(profile_table(df, options=GROUNDING_OPTIONS))["b"]["null_rate"] == 2 / 3


def test_shape_and_ranges(animals):
    profile = by_name(profile_table(animals, "stg"))
    mass = profile["body_mass_g"]
    assert (mass["row_count"], mass["column_count"], mass["type"]) == (5, 5, "double")
    assert (mass["min_value"], mass["max_value"]) == ("17.0", "495.0")
    assert profile["species"]["min_value"] is None
    assert profile["class"]["sample_values"] == ["Mammalia", "Amphibia", "Reptilia", "Teleostei"]


def test_dates_are_iso_and_decimals_floats(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-02 03:04:05' AS t, timestamp_ntz'2024-01-02 03:04:05.5' AS u,"
        " date'2024-01-02' AS d, 1.50 AS n, true AS b, array(1, 2) AS a, map('k', 1) AS m"
    )
    p = by_name(profile_table(df))
    assert [p[c]["max_value"] for c in "tudn"] == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.500000", "2024-01-02", "1.5"]
    assert p["b"]["max_value"] is None and p["b"]["sample_values"] == ["true"]
    assert p["a"]["sample_values"] == ["[1,2]"] and p["m"]["sample_values"] == ['{"k":1}']


def test_empty_table_has_no_key(spark):
    p = profile_table(spark.createDataFrame([], "id int, name string"), "empty")
    assert [(r["null_rate"], r["is_candidate_key"], r["approx_distinct"]) for r in p.collect()] == [(0.0, False, 0)] * 2
    assert grain(p).count() == 0


def test_wide_tables_are_read_in_parts(animals):
    whole = profile_table(animals, "t").collect()
    parts = profile_table(animals, "t", options=ProfileOptions(columns_per_pass=2)).collect()
    assert sorted(whole) == sorted(parts)


def test_estimates_are_close_and_keys_exact(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 7000).alias("r"), F.concat(F.lit("t"), "id").alias("s"))
    p = by_name(profile_columns(df))
    assert p["id"]["exact_distinct"] == p["s"]["exact_distinct"] == 50_000
    assert p["r"]["exact_distinct"] is None and abs(p["r"]["approx_distinct"] - 7000) < 700
    assert p["id"]["is_candidate_key"] and p["s"]["is_candidate_key"] and not p["r"]["is_candidate_key"]


def test_near_unique_text_is_counted_by_value(spark):
    df = spark.range(1000).select(F.concat(F.lit("t"), F.least("id", F.lit(989))).alias("s"))
    assert exact_distincts(df, df.schema.fields, 1000) == {"s": 990}
    p = by_name(profile_columns(df))["s"]
    assert p["exact_distinct"] == p["approx_distinct"] == 990 and not p["is_candidate_key"]


def test_samples_skip_wide_columns(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("k"))
    p = by_name(profile_table(df, options=ProfileOptions(sample_max_distinct=2000)))
    assert p["id"]["sample_values"] == [] and p["k"]["sample_values"] == ["0", "1", "2"]


def test_samples_equal_brute_force(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([1, 2, 10, 20, 30, 100, 5, 7, 8, 9, 11]), rnd.choice("abcdefghijklm")) for _ in range(400)]
    df = spark.createDataFrame(data, "n int, s string")
    found = {}
    for r in sample_values(df, ["n", "s"]).orderBy("rank").collect():
        found.setdefault(r["column_name"], []).append((r["value"], r["n"]))
    for i, name in enumerate(["n", "s"]):
        column = [d[i] for d in data]
        top = sorted(set(column), key=lambda v: (-column.count(v), v))[:8]
        assert found[name] == [(str(v), column.count(v)) for v in top]


def test_grounding_samples_only_some_types(animals):
    p = by_name(profile_table(animals, options=GROUNDING_OPTIONS))
    assert p["body_mass_g"]["sample_values"] == [] and p["animal_no"]["sample_values"] != []


def test_grain_is_the_shortest_unique_name(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 2, 5)], "long_id int, id int, v int")
    assert rows(grain(profile_columns(df, "t"))) == [("t", "id")]


def tables(spark):
    return {
        "customers": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "customer_id int, label string"),
        "orders": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "order_no int, CUSTOMER_ID int"),
        "visits": spark.createDataFrame([(1,), (1,), (3,)], "customer_id int"),
        "cards": spark.createDataFrame([("1",), ("2",)], "customer_id string"),
    }


def test_relationships(spark):
    found = rows(infer_relationships(profile_many_columns(tables(spark))))
    assert ("customers", "orders", "customer_id", "1:many") in found
    assert ("orders", "visits", "customer_id", "many:many") in found
    assert ("customers", "cards", "customer_id", "1:1") in found
    assert len(found) == 6


def test_relationships_by_grain_need_one_type(spark):
    found = rows(infer_relationships_by_grain(profile_many_columns(tables(spark))))
    assert not [r for r in found if "cards" in r[:2]]
    # 'label' is shorter and unique, so it is the grain of customers.
    assert ("customers", "orders", "customer_id", "many:many") in found


def test_suggested_checks(spark):
    profile = spark.createDataFrame(
        [("t", "HAGRID", True, 0.0), ("t", "Common name", False, 0.0), ("t", "Body mass (g)", False, 0.3)],
        "table_name string, name string, is_candidate_key boolean, null_rate double",
    )
    assert rows(suggest_checks(profile)) == [("t", "Common name", "not_null"), ("t", "HAGRID", "not_null"), ("t", "HAGRID", "unique")]


def test_schema_summary(spark):
    profile = profile_tables({k: v for k, v in tables(spark).items() if k != "cards"})
    prior = spark.sql("SELECT * FROM VALUES (1, NULL), (2, NULL) AS t(id, note)")
    prior = {"turn_1_result": prior.withColumn("note", F.col("note").cast("string"))}
    found = schema_summary(profile, infer_relationships(profile), prior).collect()
    tables_ = {r["relation"]: (r["rows"], r["subject"]) for r in found if r["kind"] == "table"}
    assert tables_["customers"] == (3, "label")
    key = next(r for r in found if (r["kind"], r["relation"], r["subject"]) == ("column", "customers", "customer_id"))
    assert (key["type"], key["not_null"], key["distinct_values"], key["exact"]) == ("int", True, 3, True)
    assert (key["low"], key["high"], key["samples"]) == ("1", "3", ["1", "2", "3"])
    links = {(r["relation"], r["target"], r["subject"], r["type"]) for r in found if r["kind"] == "link"}
    assert ("customers", "orders", "customer_id", "1:many") in links
    earlier = [(r["kind"], r["rows"], r["subject"], r["samples"]) for r in found if r["relation"] == "turn_1_result"]
    assert sorted(earlier, key=str) == sorted(
        [("result", 2, None, None), ("result_column", None, "id", ["1", "2"]), ("result_column", None, "note", [])], key=str
    )


def test_an_earlier_result_is_read_as_a_whole(spark):
    late = {"r": spark.range(3000).select(F.when(F.col("id") >= 2000, F.lit("x")).alias("v"))}
    empty = profile_tables({"t": spark.range(1)})
    found = schema_summary(empty, infer_relationships(empty), late).where("kind = 'result_column'").collect()
    assert [r["samples"] for r in found] == [["x"]]


def test_grounding_names_all_tables_of_the_databases(spark, zoo):
    found = ground(spark, zoo.databases).where("kind = 'table'").collect()
    assert {"zoo_staging.stg_animals", "zoo_marts.mart_longevity_by_class"} <= {r["relation"] for r in found}
    assert ground(spark, []).count() == 0


def test_maps_anywhere_and_many_values_are_profiled(spark):
    df = spark.range(50).selectExpr(
        "id", "array(map('k', id % 3)) AS deep", "named_struct('m', map('k', 1)) AS nested", "parse_json(concat('{\"a\":', id, '}')) AS v"
    )
    p = by_name(profile_table(df))
    assert p["deep"]["null_count"] == 0 and p["v"]["exact_distinct"] == 50 and p["id"]["sample_values"] == [str(i) for i in range(8)]


@pytest.mark.parametrize("name", ["a.b", "x`y", "Body mass (g)"])
def test_any_column_name(spark, name):
    df = spark.createDataFrame([(1,), (2,)], ["v"]).toDF(name)
    p = profile_table(df).collect()[0]
    assert p["name"] == name and p["is_candidate_key"] and p["sample_values"] == ["1", "2"]
