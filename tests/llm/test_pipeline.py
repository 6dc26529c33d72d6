import collections

import corpus_pipeline

from verisift.llm import decontamination, mixing, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if name in ("toxicity", "decontamination", "near_duplicates"):
            assert docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            own = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(own.values()))
        if name == "decontamination":
            m = decontamination.mark_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in m.where("not contaminated").collect())
        if name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.mix(before, seed=6).collect() if r.copies}
            assert collections.Counter(r.doc_id for r in docs.collect()) == want
    n = collections.Counter(r.shard for r in docs.collect())
    assert len(n) == 24 and max(n.values()) - min(n.values()) <= 1 and set(columns) < set(docs.columns)
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert collections.Counter(r.doc_id for r in whole.collect()) == collections.Counter(r.doc_id for r in docs.collect()) and len(key(whole)) == kept[-1]


def test_same_input_same_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("mixing", "sharding"):
        stage = dict(corpus_pipeline.STAGES)[name]
        a, b = (sorted(map(str, stage(spark, docs, SF).collect())) for _ in range(2))
        assert a == b
