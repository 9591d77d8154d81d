"""The corpus pipeline over the smallest tables, stage by stage."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as p
    from litmill.llm import decontamination, lines, minhash, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        source = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            scored = toxicity.score(source, toxicity.train(source, spark.read.parquet(f"{SF}/labels.parquet")))
            assert set(after) == {r.doc_id for r in scored.collect() if r.predicted == 0}
        elif name == "line_dedup":
            left = {r.doc_id: r.text for r in lines.dedup_lines(source).collect()}
            assert after == {d: t for d, t in left.items() if t.strip() or t == before[d]}
        elif name == "near_dedup":
            assert set(after) == {r.doc_id for r in minhash.near_duplicates(source).collect() if r.kept}
        else:
            found = decontamination.find(source, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert set(after) == {r.doc_id for r in found.collect() if not r.contaminated}
        before = after
    pieces = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(before)
