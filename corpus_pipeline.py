"""A training-data pipeline of the llm operators over ``documents``.

Stages, in order: quality classifier, line dedup, near-copy dedup, PII sanitising,
packing.  Each takes (spark, docs, sf_dir); all but the last return the columns of
documents.  What one stage drops or changes is dropped or changed for all that follow.
"""

from __future__ import annotations

from castwise.llm.boosted_trees import drop_low_quality
from castwise.llm.common import table
from castwise.llm.line_dedup import deduplicated
from castwise.llm.near_copies import drop_near_copies
from castwise.llm.packing import pack
from castwise.llm.pii import sanitised
from castwise.llm.queries import tokenizer_path


def quality(spark, docs, sf_dir):
    """Documents that score under 0.7 go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"), keep=0.7, sample=20_000)


def lines(spark, docs, sf_dir):
    """Later repeats of runs of at least five words go; so do documents that have no words left."""
    return deduplicated(docs, min_words=5)


def near_duplicates(spark, docs, sf_dir):
    """One document of each component stays; links are five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return drop_near_copies(docs, similarity=0.8)


def personal_data(spark, docs, sf_dir):
    """Personal data and the terms that disclose it are generalised or removed."""
    return sanitised(docs)


def packing(spark, docs, sf_dir):
    """The pieces of all documents in their sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express the classifier, the near copies' components or the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages one after another; each result is written to the shared folder and read again."""
    from castwise.llm.common import new_dir

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
