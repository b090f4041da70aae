import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import sets
from tidemill.operators.joins import fanout, join_preaggregated, orphan_keys, orphan_rows, with_scalars

from conftest import plan_of, rows


@pytest.fixture(scope="module")
def family(spark):
    """Parents with one that has a third of all children, some with none, and orphans."""
    rnd = random.Random(5)
    parents = [(k, float(k) * 1.5 if k % 4 else None) for k in range(40)] + [(None, 2.0)]
    children = [(7 if i % 3 == 0 else rnd.randrange(20, 50), i) for i in range(900)] + [(None, -1)]
    return (
        parents, children,
        spark.createDataFrame(parents, "k int, m double"), spark.createDataFrame(children, "pk int, c int"),
    )


def test_fanout_equals_the_real_join(family):
    parents, children, p, c = family
    found = fanout(p, c, "k", "pk", "m").first()
    joined = [(k, m) for k, m in parents for ck, _ in children if k is not None and k == ck]
    matched = {k for k, _ in joined}
    assert found["parent_rows"] == len(parents) and found["matched_rows"] == len(matched)
    assert found["joined_rows"] == len(joined) and found["max_children"] == 300
    assert found["sum_after"] == pytest.approx(sum(m for _, m in joined if m is not None))
    assert found["sum_before"] == pytest.approx(sum(m for k, m in parents if k in matched and m is not None))
    assert found["fanout_risk"] and found["fanout_factor"] == pytest.approx(len(joined) / len(matched))


def test_no_risk_for_one_child_each(spark):
    p, c = spark.range(5).toDF("k"), spark.range(3).toDF("pk")
    assert fanout(p, c, "k", "pk").first().asDict() == {
        "parent_rows": 5, "matched_rows": 3, "joined_rows": 3, "max_children": 1, "fanout_factor": 1.0, "fanout_risk": False,
    }
    assert fanout(p, c.where("false"), "k", "pk").first()["fanout_risk"] is False


def test_preaggregated_join_keeps_parent_rows(family):
    parents, children, p, c = family
    joined = join_preaggregated(p, c, "k", "pk", [F.count(F.lit(1)).alias("n")])
    counts = {k: sum(ck == k for ck, _ in children) or None for k, _ in parents if k is not None}
    assert joined.count() == len(parents)
    assert {r["k"]: r["n"] for r in joined.collect() if r["k"] is not None} == counts


def test_orphans(family):
    parents, children, p, c = family
    known = {k for k, _ in parents}
    found = {r["value"]: r["n_rows"] for r in orphan_keys(c, "pk", p, "k").collect()}
    expected = {k for k, _ in children if k is not None and k not in known}
    assert found == {k: sum(ck == k for ck, _ in children) for k in expected}


def test_orphan_rows(family):
    parents, children, p, c = family
    known = {k for k, _ in parents}
    assert rows(orphan_rows(c, "pk", p.union(p), "k")) == sorted((k, i) for k, i in children if k is not None and k not in known)


def test_orphan_rows_shuffle_keys_only(family):
    _, _, p, c = family
    plan = plan_of(orphan_rows(c, "pk", p, "k")).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_fanout_folds_repeated_parents(family):
    parents, children, p, c = family
    found = fanout(p.union(p), c, "k", "pk", "m").first()
    once = fanout(p, c, "k", "pk", "m").first()
    for name in ("parent_rows", "matched_rows", "joined_rows"):
        assert found[name] == 2 * once[name]
    assert found["sum_after"] == pytest.approx(2 * once["sum_after"]) and found["fanout_factor"] == once["fanout_factor"]


def test_scalars_are_no_join(spark):
    df = spark.range(10)
    out = with_scalars(df, df.agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")))
    assert out.where("id = 3").first().asDict() == {"id": 3, "top": 9, "n": 10}
    plan = plan_of(out)
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_scalars_refuse_a_second_row(spark):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        with_scalars(spark.range(3), spark.range(2).toDF("x")).collect()


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    assert rows(sets.union(a, b)) == [(None,), (1,), (2,), (3,)]
    assert rows(sets.intersect(a, b)) == [(None,), (1,)]
    assert rows(sets.subtract(a, b)) == [(2,)]


def test_set_operations_shuffle_once(spark):
    a, b = spark.range(10).toDF("v"), spark.range(5, 15).toDF("v")
    for operation in (sets.union, sets.intersect, sets.subtract):
        physical = plan_of(operation(a, b)).split("== Physical Plan ==")[1]
        assert physical.count("Exchange hashpartitioning") == 1 and "Join" not in physical
