import pytest
from pyspark.sql import functions as F

from tidemill.operators import checks
from tidemill.operators.expectations import expect
from tidemill.operators.monitoring import (
    dataset_metrics,
    load_snapshot,
    previous_snapshot,
    rowcount_drift,
    rowcount_snapshot,
    save_snapshot,
)
from tidemill.operators.sanity import result_sanity
from tidemill.sinks.landing import save_table
from tidemill.sinks.models import save_view
from tidemill.sources.catalog import Layers

from conftest import plan_of, rows


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "t": spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "z"), (None, "z")], "k int, s string"),
        "p": spark.createDataFrame([(1,), (None,)], "k int"),
    }


SUITE = [
    checks.not_null("t", "k"),
    checks.not_null("p", "k"),
    checks.unique("t", "k"),
    checks.unique("p", "k"),
    checks.accepted_values("t", "s", ["a", "b"]),
    checks.relationship("t", "k", "p", "k"),
]


def test_report(spark, tables):
    suite = SUITE + [
        checks.singular("none", tables["t"].where("k > 5")),
        checks.not_null("t", "missing"),
        checks.unique("nowhere", "k"),
    ]
    report = checks.run_checks(spark, suite, tables)
    assert {(r["name"], r["status"], r["failures"]) for r in report.collect()} == {
        ("not_null_t_k", "fail", 2), ("not_null_p_k", "fail", 1), ("unique_t_k", "fail", 1), ("unique_p_k", "pass", 0),
        ("accepted_values_t_s_a_b", "fail", 1), ("relationship_t_k_p_k", "fail", 1), ("none", "pass", 0),
        ("not_null_t_missing", "error", None), ("unique_nowhere_k", "error", None),
    }
    assert checks.totals(report).first().asDict() == {"passed": 2, "failed": 5, "errors": 2, "checks": 9}


def test_suite_with_errors_only(spark, tables):
    assert [r["status"] for r in checks.run_checks(spark, [checks.not_null("t", "x")], tables).collect()] == ["error"]


def test_failing_rows(tables):
    found = {c.kind + "_" + c.table: rows(checks.failing_rows(c, tables)) for c in SUITE}
    assert found["not_null_t"] == [(None, "z"), (None, "z")]
    assert found["unique_t"] == [(1, 2)]
    assert found["accepted_values_t"] == [("z", 2)]
    assert found["relationship_t"] == [(2, None)]
    assert checks.failing_rows(SUITE[0], tables, limit=1).count() == 1


def test_null_checks_of_a_table_are_one_scan(spark, tmp_path):
    spark.range(3).selectExpr("id AS a", "id AS b").write.parquet(str(tmp_path / "t"))
    tables = {"t": spark.read.parquet(str(tmp_path / "t"))}
    counted = checks._null_failures([checks.not_null("t", "a"), checks.not_null("t", "b")], tables["t"])
    assert plan_of(counted).split("== Physical Plan ==")[1].count("FileScan") == 1
    both = checks._value_failures([checks.unique("t", "a"), checks.accepted_values("t", "a", [0, None])], tables["t"])
    assert plan_of(both).split("== Physical Plan ==")[1].count("FileScan") == 1
    assert {r["name"]: r["failures"] for r in both.collect()} == {"unique_t_a": 0, "accepted_values_t_a_0_None": 2}


def test_a_check_that_fails_to_run_leaves_the_others(spark, tables):
    bad = checks.singular("bad_cast", tables["t"].where("CAST('x' || k AS INT) > 0"))
    report = checks.run_checks(spark, [bad, checks.unique("p", "k")], tables)
    assert {(r["name"], r["status"]) for r in report.collect()} == {("bad_cast", "error"), ("unique_p_k", "pass")}


def test_names_tell_checks_apart(spark, tables):
    a, b = checks.relationship("t", "k", "p", "k"), checks.relationship("t", "k", "q", "k")
    assert a.name != b.name and checks.accepted_values("t", "s", ["x"]).name != checks.accepted_values("t", "s", ["y"]).name
    with pytest.raises(ValueError, match="named"):
        checks.run_checks(spark, [a, a], tables)


def test_expectations(spark, animals):
    df = animals.orderBy(F.desc("longevity_yrs"))
    out = expect(
        df, row_count=5, min_rows=6, columns=["species", "nope"],
        first_row={"species": "Rougheye rockfish", "longevity_yrs": 205.0000001, "body_mass_g": 1, "nope": 1},
        all_positive=["longevity_yrs", "nope"],
    )
    assert {r["expectation"]: r["ok"] for r in out.collect()} == {
        "row_count": True, "min_rows": False, "columns": False, "all_positive.longevity_yrs": True,
        "all_positive.nope": False, "first_row.species": True, "first_row.longevity_yrs": True,
        "first_row.body_mass_g": False, "first_row.nope": False,
    }


def test_expectations_of_an_empty_result(spark, animals):
    out = expect(animals.where("false"), columns=["species"], first_row={"species": "x"}, all_positive=["body_mass_g"])
    assert {r["expectation"]: r["ok"] for r in out.collect()} == {
        "columns": False, "first_row.species": False, "all_positive.body_mass_g": True,
    }


def test_null_is_not_positive(spark):
    out = expect(spark.createDataFrame([(1,), (None,)], "n int"), all_positive=["n"])
    assert not out.first()["ok"]


@pytest.mark.parametrize(
    "sql, kinds",
    [
        ("SELECT 1 AS x WHERE false", ["empty_result"]),
        ("SELECT CAST(NULL AS INT) AS total, 2 AS n_rows", ["all_null_aggregate"]),
        ("SELECT explode(array(1.0D, 101.0D)) AS hit_rate", ["out_of_range"]),
        ("SELECT explode(array(-1, 3)) AS n_items", ["negative_count"]),
        ("SELECT explode(array(-1, 3)) AS item_count", ["negative_count"]),
        ("SELECT explode(array(double('NaN'), 50.0D)) AS pct", []),
        ("SELECT explode(array(CAST(NULL AS INT), 3)) AS n_items", []),
        ("SELECT explode(array(-1, 300)) AS generate, -2 AS county", ["negative_count"]),
        ("SELECT 'x' AS rate, true AS n_flag", []),
        ("SELECT explode(array(-5.0BD, 5.0BD)) AS share_ratio", ["out_of_range"]),
    ],
)
def test_sanity(spark, sql, kinds):
    assert [r["kind"] for r in result_sanity(spark.sql(sql)).collect()] == kinds


def test_sanity_of_repeated_names(spark):
    found = result_sanity(spark.sql("SELECT -1 AS n_a, 5 AS n_a")).collect()
    assert [(r["kind"], r["column_name"], r["low"]) for r in found] == [("negative_count", "n_a", -1.0)]


def test_drift(spark):
    previous = spark.createDataFrame([("a", 100), ("b", 100), ("c", 0), ("d", 1000), ("e", 100), ("f", 10)], "table_name string, n_rows long")
    current = spark.createDataFrame([("a", 119), ("b", 120), ("c", 9), ("g", 2500), ("e", 80), ("f", 10)], "table_name string, n_rows long")
    assert {r["table_name"]: (r["kind"], r["previous_rows"], r["current_rows"]) for r in rowcount_drift(previous, current).collect()} == {
        "b": ("up", 100, 120), "d": ("dropped", 1000, None), "e": ("down", 100, 80), "g": ("new", None, 2500),
    }


def test_snapshots(spark, zoo, tmp_path):
    counts = rowcount_snapshot(spark, zoo.databases)
    assert rows(counts) == [("zoo_marts.mart_longevity_by_class", 4), ("zoo_staging.stg_animals", 5)]
    assert dataset_metrics(counts).first().asDict() == {"n_sources": 0, "n_staging": 1, "n_marts": 1, "raw_rows": 0}
    path = str(tmp_path / "state")
    assert previous_snapshot(spark, path, "2") is None
    save_snapshot(counts, path, "2024-01-01")
    save_snapshot(counts.where("n_rows > 4"), path, "2024-01-02")
    save_snapshot(counts.where("n_rows > 4"), path, "2024-01-02")
    assert previous_snapshot(spark, path, "2024-01-01") is None
    assert previous_snapshot(spark, path, "2024-01-02").count() == 2
    assert previous_snapshot(spark, path, "2024-01-03").count() == 1
    assert load_snapshot(spark, path, "2024-01-01").count() == 2


def test_snapshot_leaves_broken_views_out(spark, tmp_path):
    layers = Layers("broken", str(tmp_path)).create(spark)
    for name in ("kept", "gone"):
        save_table(spark.range(4), layers.raw, name)
        save_view(spark, layers.staging, f"stg_{name}", f"SELECT * FROM {layers.raw}.{name}")
    spark.sql(f"DROP TABLE {layers.raw}.gone")
    assert rows(rowcount_snapshot(spark, layers.databases)) == [("broken_raw.kept", 4), ("broken_staging.stg_kept", 4)]


def test_snapshot_of_nothing(spark):
    assert rowcount_snapshot(spark, []).count() == 0
