import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemill.operators.ranking import (
    bracket,
    bracketed_medians,
    global_rank,
    grouped_median,
    numbered_ranges,
    top_k,
    top_values,
)

from conftest import plan_of, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, and most rows are in one group."""
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        group = "hot" if i % 4 else rnd.choice(["a", "b", "c", None])
        value = 5.0 if i % 3 == 0 else (None if i % 50 == 1 else round(rnd.uniform(0, 100), 1))
        data.append((i, group, value))
    data += [(9001, "nulls", None), (9002, "one", 3.5)]
    return data, spark.createDataFrame(data, "id int, g string, v double").repartition(8)


def test_global_rank_equals_sorting(skewed):
    data, df = skewed
    ranked = global_rank(df, [F.desc_nulls_last("v"), F.asc("id")], "rank")
    expected = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {r[0]: i for i, r in enumerate(expected, 1)}


def test_global_rank_uses_no_window_and_many_tasks(skewed):
    _, df = skewed
    ranked = global_rank(df, [F.desc_nulls_last("v"), F.asc("id")], "rank")
    plan = plan_of(ranked)
    assert "Window" not in plan and "SinglePartition" not in plan


def test_a_frequent_value_spans_partitions(spark):
    """A third of the rows have one value; no partition may hold them all."""
    n = 30_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = numbered_ranges(df, [F.asc("v"), F.asc("id")]).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * n / 8


def test_global_rank_of_nothing(skewed):
    _, df = skewed
    assert global_rank(df.where("false"), [F.asc("id")], "rank").count() == 0


def medians(data):
    groups = {}
    for _, g, v in data:
        groups.setdefault(g, [])
        if v is not None:
            groups[g].append(v)
    return {g: (statistics.median(v) if v else None) for g, v in groups.items()}


def test_ranged_median_equals_brute_force(skewed):
    data, df = skewed
    found = {r["g"]: r["median"] for r in grouped_median(df, ["g"], "v").collect()}
    assert found == pytest.approx(medians(data))


def test_median_without_keys(skewed):
    data, df = skewed
    assert grouped_median(df, [], "v").first()["median"] == pytest.approx(statistics.median([v for _, _, v in data if v is not None]))
    assert [r["median"] for r in grouped_median(df.where("false"), [], "v").collect()] == [None]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 101])
def test_ranged_median_of_n(spark, n):
    df = spark.range(n).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"))
    assert grouped_median(df, ["g"], "v").first()["median"] == statistics.median(range(n))


def test_only_values_near_the_middle_are_shuffled(spark):
    n = 40_000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.rand(5).alias("v"))
    brackets = df.groupBy("g").agg(*bracket("v"))
    ends = {r["g"]: (r["_low"], r["_high"]) for r in brackets.collect()}
    data = {}
    for r in df.collect():
        data.setdefault(r["g"], []).append(r["v"])
    for g, values in data.items():
        low, high = ends[g]
        assert low <= statistics.median(values) <= high and sum(low <= v <= high for v in values) < len(values) / 50
    assert {r["g"]: r["median"] for r in grouped_median(df, ["g"], "v").collect()} == {g: statistics.median(v) for g, v in data.items()}


@pytest.mark.parametrize(("low", "high"), [(0.9, 0.95), (-5.0, 0.2), (0.5, 0.5)])
def test_a_bracket_that_misses_the_middle_is_noticed(spark, low, high):
    df = spark.range(1000).select((F.col("id") % 2 == 0).alias("g"), (F.col("id") / 1000).alias("v"))
    brackets = spark.createDataFrame([(True, low, high), (False, 0.4, 0.6)], "g boolean, _low double, _high double")
    found = {r["g"]: r["m"] for r in bracketed_medians(df, brackets, ["g"], "v", "m").collect()}
    assert found == pytest.approx({True: 0.499, False: 0.5})
    alone = spark.createDataFrame([(low, high)], "_low double, _high double")
    assert bracketed_medians(df, alone, [], "v", "m").first()["m"] == pytest.approx(0.4995)


def test_medians_at_the_ends_of_the_scale(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, -inf), (1, -inf), (1, 5.0), (2, nan), (2, nan), (2, 1.0), (3, inf), (3, inf), (3, -inf)], "g int, v double")
    found = {r["g"]: r["median"] for r in grouped_median(df, ["g"], "v").collect()}
    assert found[1] == -inf and found[2] != found[2] and found[3] == inf


def test_median_over_two_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 4), (1, None, 7), (2, "a", 9)], "x int, y string, v int")
    assert rows(grouped_median(df, ["x", "y"], "v")) == [(1, None, 7.0), (1, "a", 2.5), (2, "a", 9.0)]


def test_approximate_median(skewed):
    _, df = skewed
    approx = {r["g"]: r["m"] for r in grouped_median(df, ["g"], "v", "m", accuracy=1000).collect()}
    assert approx["one"] == 3.5 and approx["nulls"] is None


def test_top_values_order_ties_by_typed_value(spark):
    df = spark.createDataFrame([(10,), (10,), (9,), (9,), (2,), (None,), (None,), (None,)], "v int")
    assert [tuple(r) for r in top_values(df, "v", 2).collect()] == [(9, 2), (10, 2)]


def test_top_k_is_one_bounded_step(animals):
    top = top_k(animals, [F.desc("longevity_yrs"), F.asc("animal_no")], 2)
    assert [r["species"] for r in top.collect()] == ["Rougheye rockfish", "Eastern box turtle"]
    assert "TakeOrderedAndProject" in plan_of(top)
