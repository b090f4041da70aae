import collections

import pytest
from pyspark.sql import functions as F

from tidemill.llm.shards import rendezvous, shard


def test_growing_moves_rows_into_the_new_shard_only(spark):
    placed = shard(spark.range(4000), "id", [1.0] * 10, [1.0] * 11).collect()
    assert all(r["grown_shard"] in (r["shard"], 10) for r in placed)
    assert 250 < sum(r["grown_shard"] == 10 for r in placed) < 480
    by = collections.defaultdict(list)
    for r in placed:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 10 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_weights_set_the_shares(spark):
    n = dict(spark.range(6000).select(rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect())
    assert 0.7 < n[1] / 6000 < 0.8
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), [1.0, 0.0])


def test_nulls_copies_and_clashing_names(spark, docs, no_docs, rows):
    table = docs.withColumn("shard", F.lit("old")).withColumn("slot", F.lit("old"))
    out = shard(table, "doc_id", [1.0] * 3, order=("text",)).collect()
    assert len(out) == len(rows) and len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert all(isinstance(r["slot"], int) for r in out) and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    assert shard(no_docs, "doc_id", [1.0] * 3).count() == 0
    assert {r["shard"] for r in shard(docs, "doc_id", [2.0]).collect()} == {0}
