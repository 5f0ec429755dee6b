"""The pipeline on nulls, empty tables, clashing columns, private data and labelled rows."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from castwise.llm.common import table
from castwise.llm.queries import tokenizer_path
from tests.llm.test_operators import CLASH, documents, edge_rows, labels, prose

PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def stages(spark, docs, where):
    """What each stage but the last returns, written and read again as run() does."""
    out = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, where).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        out.append(docs)
    return out


@pytest.mark.parametrize("none", [False, True])
def test_odd_rows_and_empty_tables(spark, tmp_path, none):
    docs = edge_rows(spark).where("false") if none else edge_rows(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).where("false").write.parquet(f"{tmp_path}/labels.parquet")
    each = stages(spark, table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert all(set(x.columns) == set(docs.columns) for x in each)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (not rows) == none
    if rows:
        assert set(PIECE) <= set(rows[0].asDict())
        kept = [r for r in each[-1].collect()]
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept} and len(kept) < docs.count()
        for r in kept:  # what other columns hold goes with its row
            assert r["doc_id"] in (4, None) or {k: r[k] for k in CLASH if k != "n_chars"} == {k: v for k, v in CLASH.items() if k != "n_chars"}


def test_each_stage_does_its_part(spark, tmp_path):
    """Rejected documents go, repeated lines go, one of near copies stays, private data is replaced, and all that is left is packed."""
    rng = random.Random(30)
    good = [prose(rng, 60) + "." for _ in range(30)]
    bad = ["!!! 000 $$$ " * rng.randint(5, 30) for _ in range(30)]
    line = prose(rng, 12)
    private = f"{prose(rng, 40)} mail ann@site.example now {prose(rng, 20)}"
    words = prose(rng, 300).split()
    near = [" ".join(words), " ".join(["changed", *words[1:]])]
    extra = [f"{prose(rng, 30)}\n{line}", f"{prose(rng, 30)}\n{line}", private, *near]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair] + extra
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    quality, lines, copies, clean = (x.collect() for x in stages(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)))
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(quality) == {i for i in range(len(texts)) if i >= 60 or i % 2 == 0}
    told = {r["doc_id"]: r["text"] for r in lines}
    assert line in told[60] and line not in told[61]
    assert ids(copies) == ids(lines) - {64} and 63 in ids(copies)
    told = {r["doc_id"]: r["text"] for r in clean}
    assert "ann@site.example" not in told[62] and "<EMAIL>" in told[62] and ids(clean) == ids(copies)
    packed = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/personal_data"), str(tmp_path)).collect()
    assert ids(packed) == ids(clean) and tokenizer_path("word_bpe_49k.json")
    for i in ids(packed):
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in packed if r["doc_id"] == i)
        assert own[0][0] == 0 and sum(x[1] for x in own) == own[0][2]
