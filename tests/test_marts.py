import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions.columns import text_key
from tidemill.operators import checks, ranking
from tidemill.plans import golden, marts, reports
from tidemill.plans.operate import Plan, operate
from tidemill.sinks.landing import Dataset, TableSpec

from conftest import plan_of, rows


def test_stats_by_group(animals):
    stats = marts.stats_by_group(animals, "class", "longevity_yrs", "body_mass_g")
    out = [tuple(r) for r in stats.collect()]
    assert out[0] == ("Teleostei", 1, 1, 205.0, 205.0, 205.0, 205.0, 495.0)
    assert out[-1] == ("Mammalia", 2, 2, 17.5, 17.5, 31.0, 4.0, 27.5)


def test_groups_without_a_value_are_dropped(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), ("b", 1.0, None), (None, 2.0, 1.0)], "g string, v double, w double")
    stats = marts.stats_by_group(df, "g", "v", "w")
    assert rows(stats.select("g", "n_rows", "n_with_value")) == [(None, 1, 1), ("b", 1, 1)]


def test_figures_equal_plain_aggregates(spark):
    rnd = random.Random(2)
    data = [(None if i % 11 == 0 else ("hot" if i % 3 else f"g{i % 5}"), None if i % 7 == 0 else rnd.uniform(0, 9), float(i)) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, v double, w double")
    plain = df.groupBy("g").agg(
        F.count(F.lit(1)), F.count("v"), F.round(F.avg("v"), 2), F.round(F.median("v"), 2), F.max("v"), F.min("v"), F.round(F.avg("w"), 1)
    )
    assert rows(marts.stats_by_group(df, "g", "v", "w")) == rows(plain)


def test_the_median_shuffles_a_few_per_cent_of_the_input(spark, monkeypatch):
    """The input is read twice, once for all other figures and a bracket; what the median counts is little of it."""
    shuffled = []
    original = ranking._ranged

    def counted(weighted, keys):
        shuffled.append(original(weighted, keys))
        return shuffled[-1]

    monkeypatch.setattr(ranking, "_ranged", counted)
    n = 30_000
    df = spark.range(n).select((F.col("id") % 4).alias("g"), F.rand(3).alias("v"), F.rand(4).alias("w"))
    found = rows(marts.stats_by_group(df, "g", "v", "w", 6, 6).select("g", "median_value"))
    assert found == rows(df.groupBy("g").agg(F.round(F.median("v"), 6)))
    assert len(shuffled) == 1 and shuffled[0].count() < n / 40


def fit(points):
    xs, ys = [math.log(x) for x, _ in points], [math.log(y) for _, y in points]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    return slope, my - slope * mx


def test_power_law_outliers(spark, animals):
    data = [(r["animal_no"], r["body_mass_g"], r["longevity_yrs"]) for r in animals.collect()]
    slope, intercept = fit([(x, y) for _, x, y in data])
    expected = sorted(((math.log(y) - intercept - slope * math.log(x), k) for k, x, y in data), reverse=True)
    # Rows outside the law's domain are neither fitted nor ranked.
    more = animals.union(spark.createDataFrame([(6, "x", "y", 0.0, 5.0), (7, "x", "y", 5.0, None)], animals.schema))
    for write_base in (False, True):
        mart = marts.power_law_outliers(more, "animal_no", "body_mass_g", "longevity_yrs", ["species"], write_base)
        ranked = mart.orderBy("overperformer_rank").collect()
        assert [r["animal_no"] for r in ranked] == [k for _, k in expected]
        assert [r["overperformer_rank"] for r in ranked] == [1, 2, 3, 4, 5]
        for r, (residual, _) in zip(ranked, expected):
            assert r["residual_ln"] == pytest.approx(residual, abs=1e-4)
            assert r["value_ratio"] == pytest.approx(math.exp(residual), abs=1e-3)
            size = math.exp(intercept + slope * math.log(r["body_mass_g"]))
            assert r["predicted_value"] == pytest.approx(size, abs=1e-2)
            assert r["value_gap"] == pytest.approx(r["longevity_yrs"] - size, abs=1e-2)


def test_equal_residuals_are_ordered_by_key(spark):
    df = spark.createDataFrame([(i, 2.0 if i % 3 else 4.0, 3.0) for i in range(300)], "k int, x double, y double")
    mart = marts.power_law_outliers(df, "k", "x", "y")
    by_rank = [r["k"] for r in mart.orderBy("overperformer_rank").collect()]
    groups = [[k for k in by_rank if k % 3], [k for k in by_rank if not k % 3]]
    assert all(g == sorted(g) for g in groups) and len(by_rank) == 300


def test_published_ratios_follow_from_their_columns():
    # Actual over predicted years of the three best-known outliers.
    for actual, predicted, ratio in ((205, 15.6, 13.1), (102, 9.8, 10.4), (138, 15.0, 9.2)):
        assert round(actual / predicted, 1) == ratio


def test_filtered_projection(spark):
    df = spark.createDataFrame([(1, 5.0, None, None), (2, None, 1.0, 1.0), (3, 9.0, None, 2.0), (4, 7.0, 1.0, None)], "k int, need double, a double, b double")
    out = marts.filtered_projection(df, ["k", "need"], "need", ["a", "b"], [F.desc("need")])
    assert [r["k"] for r in out.collect()] == [3, 4]


def test_ratio_by_group(spark):
    df = spark.createDataFrame([("a", 1.0)] * 10 + [("b", 9.0)] * 9 + [("c", 2.0)] * 12, "g string, value_ratio double")
    assert [tuple(r) for r in marts.ratio_by_group(df, "g").collect()] == [("c", 12, 2.0), ("a", 10, 1.0)]


def test_reports(animals):
    stats = marts.stats_by_group(animals, "class", "longevity_yrs", "body_mass_g")
    assert [r["class"] for r in reports.top_groups(stats, "class", min_values=2).collect()] == ["Mammalia"]
    assert [r["class"] for r in reports.top_groups(stats, "class", min_values=1, k=2).collect()] == ["Teleostei", "Reptilia"]
    assert reports.mart_frame(stats, cap=3).count() == 3
    trend = reports.power_trend(animals.select("body_mass_g", "longevity_yrs"), "body_mass_g", "longevity_yrs")
    slope, intercept = fit([(r["body_mass_g"], r["longevity_yrs"]) for r in animals.collect()])
    for r in trend.collect():
        assert r["trend"] == pytest.approx(math.exp(intercept) * r["body_mass_g"] ** slope, abs=1e-2)


def test_revenue_by_region(sales):
    by_region = sales.groupBy("region").agg(F.sum("revenue").alias("revenue")).orderBy(F.desc("revenue"))
    assert [tuple(r) for r in by_region.collect()] == [("West", 1745), ("South", 1130), ("East", 555), ("North", 210)]


def test_standing_questions(animals):
    stats = marts.stats_by_group(animals, "class", "longevity_yrs", "body_mass_g")
    assert rows(golden.largest_group(stats, "class")) == [("Mammalia", 2)]
    assert rows(golden.average_of(stats, "class", "Mammalia")) == [("Mammalia", 17.5)]
    assert rows(golden.group_with_maximum(stats, "class")) == [("Teleostei", 205.0)]
    assert rows(golden.total_rows(stats)) == [(5,)]
    outliers = marts.power_law_outliers(animals, "animal_no", "body_mass_g", "longevity_yrs", ["species"])
    scores = marts.power_law_scores(animals, "animal_no", "body_mass_g", "longevity_yrs", ["species"])
    best = golden.largest_for_size(scores, "animal_no", ["species", "overperformer_rank"], 2).collect()
    assert [r["overperformer_rank"] for r in best] == [1, 2]
    assert golden.top_overperformer(scores, "animal_no", ["species"]).first()["species"] == best[0]["species"] == "Olm"
    assert rows(golden.rank_of(outliers, "species", "Olm")) == [("Olm", 1)]


def test_text_key(spark):
    df = spark.createDataFrame([("Homo", "sapiens"), ("Homo", None), ("", ""), (" ", " x ")], "g string, s string")
    assert [r[0] for r in df.select(text_key(F.col("g"), F.col("s"))).collect()] == ["Homo sapiens", None, None, "x"]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(9).selectExpr("id", "id * 2 AS x", "id * 3 AS y", "'t' AS t").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_of(marts.power_fit(df, "x", "y"))
    assert "GreaterThan(x,0)" in plan and "ReadSchema: struct<x:bigint,y:bigint>" in plan


def test_operate(spark, tmp_path):
    def source(n):
        path = tmp_path / f"orders-{n}.csv"
        path.write_text("Order ID,Region,Revenue\n" + "".join(f"{i},{'West' if i % 3 else 'East'},{i * 10}\n" for i in range(n)))
        return str(path)

    def plan(n):
        return Plan(
            Dataset("shop", [TableSpec(source(n), "orders")], str(tmp_path / "db")),
            staging={"stg_west": "SELECT * FROM {staging}.stg_orders WHERE region = 'West'"},
            marts={"mart_revenue": lambda t: t["stg_orders"].groupBy("region").agg(F.sum("revenue").alias("revenue"))},
            checks=[
                checks.unique("stg_orders", "order_id"),
                checks.not_null("mart_revenue", "revenue"),
                checks.accepted_values("stg_orders", "region", ["West"]),
            ],
            state=str(tmp_path / "state"),
        )

    first = operate(spark, plan(10), "2024-01-01")
    assert first.landed == {"orders": 10} and first.drift is None and not first.passed
    assert rows(first.checks.select("name", "status")) == [
        ("accepted_values_stg_orders_region_West", "fail"), ("not_null_mart_revenue_revenue", "pass"), ("unique_stg_orders_order_id", "pass"),
    ]
    assert [tuple(r) for r in first.examples["accepted_values_stg_orders_region_West"]] == [("East", 4)]
    assert {r["name"] for r in first.profile.where("is_candidate_key").collect()} == {"Order ID", "Revenue"}

    second = operate(spark, plan(20), "2024-01-02")
    assert rows(second.counts) == [
        ("shop_marts.mart_revenue", 2), ("shop_raw.orders", 20), ("shop_staging.stg_orders", 20), ("shop_staging.stg_west", 13),
    ]
    assert rows(second.drift.select("table_name", "kind")) == [
        ("shop_raw.orders", "up"), ("shop_staging.stg_orders", "up"), ("shop_staging.stg_west", "up"),
    ]
