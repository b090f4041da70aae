import pytest
from llm.corpus import prose
from llm.test_ngram_join import brute as groups
from llm.test_suffix_dedup import brute as repeats

import corpus_pipeline
from tidemill.session import new_scratch


@pytest.fixture(scope="module")
def tables(spark, rows):
    """The small corpus with toxic texts, a leaked benchmark item and labels, as files."""
    folder = new_scratch(spark, "pipeline")
    item = prose(7000, 30)
    toxic = [(200 + i, f"{prose(8000 + i, 30)} vilewort grimble vilewort {prose(9000 + i, 20)}", "en", "s", 1) for i in range(60)]
    clean = [(300 + i, prose(8500 + i, 50), "en", "s", 1) for i in range(60)]
    leaked = [(500, f"{prose(1, 8)} {item} {prose(2, 8)}", "en", "s", 1)]
    docs = [*rows, *toxic, *clean, *leaked]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int(r in toxic)) for r in toxic[:50] + clean]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


def test_stages_against_brute_force(spark, tables):
    folder, docs = tables
    frame, names = spark.read.parquet(f"{folder}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "suffix_dedup", "decontamination", "byte_bpe"]
    out = {}
    for name, function in corpus_pipeline.STAGES:
        frame = function(spark, frame, folder)
        path = new_scratch(spark, name)
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        out[name] = [tuple(r) for r in frame.collect()]
    ids = lambda rows: sorted((r[0] is None, r[0] or 0) for r in rows)
    assert ids(out["toxicity"]) == ids(r for r in docs if not (r[0] and 200 <= r[0] < 300))
    parts = groups(out["toxicity"], 5, 80)
    wordless = sum(p[1] == 0 for p in parts)
    assert len(out["ngram_join"]) == len({p[3] for p in parts if p[1]}) + wordless
    expected = [kept.decode(errors="ignore") for kept, _ in repeats([r[1] for r in out["ngram_join"]], 200)]
    assert sorted(expected) == sorted(r[1] or "" for r in out["suffix_dedup"])
    assert ids(out["suffix_dedup"]) == ids(out["ngram_join"])
    assert all(r[1] is None or r[4] is None or r[4] == 1 or r[4] == len(r[1]) for r in out["suffix_dedup"])
    assert ids(out["decontamination"]) == ids(r for r in out["suffix_dedup"] if r[0] != 500)
    assert ids(out["byte_bpe"]) == ids(out["decontamination"]) and all(r[5] for r in out["byte_bpe"])
    assert ids(map(tuple, corpus_pipeline.run(spark, folder).collect())) == ids(out["byte_bpe"])


def test_stages_pass_empty_tables_on(spark, tables):
    folder, _ = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        frame = function(spark, frame, folder)
    assert frame.count() == 0
