from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_near_copies import kept_by_rule, planted
from tests.llm.test_operators import documents, labels, lines_by_rule


def test_pipeline_is_its_stages_in_order(spark, tmp_path):
    texts = planted(random.Random(16))
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).where("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")  # no labels: all texts are kept
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    left = [(i, t) for i, t in enumerate(lines_by_rule(texts)) if t.split()]  # exact copies have no words left
    want = {left[k][0] for k in kept_by_rule([t for _, t in left])}
    assert len(texts) > len(left) > len(want) and got == want
