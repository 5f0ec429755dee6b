from __future__ import annotations

import random

from castwise.llm import imatch as im
from castwise.llm.common import text_hash
from castwise.llm.common import texts as plain
from tests.llm.test_operators import documents, prose


def alike(a, b):
    parts = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    told = [(x, y) for x, y in parts if {x, y} != {"........"}]
    return sum(x == y for x, y in told) / len(told)


def hot(rng):
    """A third near copies, each with two words changed; the rest from a vocabulary of its own."""
    base, pool = prose(rng, 200).split(), [prose(rng, 1) for _ in range(2000)]
    out = []
    for _ in range(40):
        w = list(base)
        for at in rng.sample(range(200), 2):
            w[at] = rng.choice(pool)
        out.append(" ".join(w))
    return out + [" ".join(rng.choices(pool, k=150)) for _ in range(80)]


def test_near_copies_of_a_hot_group_match(spark):
    rows = im.imatch(documents(spark, hot(random.Random(13))), low=0.002, high=0.2).orderBy("doc_id").collect()
    prints = [r["fingerprint"] for r in rows]
    assert sum(alike(prints[0], p) for p in prints[1:40]) / 39 > 0.6
    assert sum(alike(prints[0], p) for p in prints[40:]) / 80 < 0.1
    assert sum(r["near_edited"] > 0 for r in rows[1:40]) >= 35


def test_copies_change_no_lexicon(spark):
    texts = hot(random.Random(14))[40:]
    keyed = lambda t: plain(documents(spark, t)).withColumn("th", text_hash())
    once, often = ({r["term"] for r in im.lexicon(keyed(t), 0.002, 0.2).collect()} for t in (texts, texts + texts[:1] * 60))
    assert once and once == often


def test_repeated_neighbours_do_not_multiply(spark):
    """Two documents that follow each other, both repeated, give what they give once."""
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(12)]
    rows_once = documents(spark, texts)
    hot_rows = rows_once.where("doc_id < 10").unionByName(rows_once.where("doc_id >= 10").join(spark.range(400).select(), how="cross"))
    once = {r["doc_id"]: r for r in im.imatch(rows_once, low=0.0, high=1.0).collect()}
    rows = im.imatch(hot_rows, low=0.0, high=1.0).collect()
    assert len(rows) == 10 + 800
    assert all(r == once[r["doc_id"]] for r in rows)
