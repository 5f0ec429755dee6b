"""Substring dedup against the rule window by window."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from castwise.llm import substrings as sub
from tests.llm.test_operators import documents, edge_rows


def by_rule(rows, words=20):
    """{(doc_id, text): (n_words, kept)} of distinct rows in order of (doc_id, text hash is free: ids are distinct here)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = (text or "").encode().split()
        gone = np.zeros(len(own), bool)
        for at in range(len(own) - words + 1):
            window = tuple(own[at : at + words])
            if window in seen:
                gone[at : at + words] = True
            seen.add(window)
        out[i] = (len(own), int(gone.sum()), b" ".join(w for w, g in zip(own, gone, strict=True) if not g).decode())
    return out


def check(spark, texts, words=20, partitions=3):
    frame = documents(spark, texts).repartition(partitions)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in sub.substring_dedup(frame, words).collect()}
    assert got == by_rule(list(enumerate(texts)), words)
    return got


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def planted(rng, n=60):
    """Passages at all offsets, cut short, overlapping themselves; near copies; copies; windows that meet by a third text only."""
    passages = [prose(rng, rng.randint(18, 70)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.randrange(6)
        own = prose(rng, rng.randint(0, 120))
        if kind == 0:
            words = rng.choice(passages).split()
            a = rng.randrange(len(words) // 2)
            own = " ".join([own, *words[a : a + rng.randint(8, 60)], prose(rng, rng.randint(0, 30))])
        elif kind == 1 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(1, 3)):
                if words:
                    words[rng.randrange(len(words))] = "edited"
            own = "\n".join(words)
        elif kind == 2 and texts:
            own = rng.choice(texts)
        elif kind == 3:
            own = " ".join(rng.choice(["a b c", "a b", "x"]) for _ in range(rng.randint(20, 60)))  # periodic
        elif kind == 4:
            own = f" {rng.choice(passages)} \t{own} {rng.choice(passages)}"
        texts.append(own)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_rule(spark, seed):
    got = check(spark, planted(random.Random(seed)), partitions=1 + seed * 2)
    assert any(v[1] for v in got.values())


@pytest.mark.parametrize("words", [1, 5, 12, 31, 50])
def test_other_lengths(spark, words):
    check(spark, planted(random.Random(words), 30), words)


def test_a_passage_in_every_text_and_thousands_of_copies(spark, monkeypatch):
    rng = random.Random(9)
    passage = prose(rng, 52)
    texts = [f"{prose(rng, 10)} {passage} {prose(rng, 10)}" for _ in range(300)] + [texts_of(passage)] * 400
    got = check(spark, texts, partitions=4)
    assert sum(v[1] >= 52 for v in got.values()) >= 698


def texts_of(passage):
    return f"only copies {passage} of one"


def test_anchors_of_one_slice_send_one_row(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{prose(rng, 13 * 2)} {passage}" for _ in range(50)]
    import pyarrow as pa

    class Notes:
        def of(self, part):
            return [np.arange(50), np.arange(50) * 66]

    batch = pa.RecordBatch.from_pydict({"place": pa.array(range(50), pa.int64()), "text": texts})
    out = sub.anchors(batch, Notes(), 20).to_pandas()
    hot = out[out.rep.notna() & (out.rep == out.g)]
    sent = Counter(zip(out.k1, out.k2, strict=True))
    assert len(hot) and max(sent.values()) == 1  # the others carry keys of their own


def test_covers():
    for period, cover in sub.COVERS.items():
        for shift in range(period):
            assert any((x in cover) and ((x + shift) % period in cover) for x in range(period))


def test_edges(spark):
    docs = edge_rows(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sub.substring_dedup(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    want = by_rule(list(dict.fromkeys(rows)))
    assert all((r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]] for r in got)
    assert sub.substring_dedup(docs.where("false")).count() == 0


def test_repeated_rows_are_one_document_and_one_id_may_have_two_texts(spark):
    rng = random.Random(4)
    a, b = prose(rng, 50), prose(rng, 50)
    docs = documents(spark, [a, b]).unionByName(documents(spark, [a])).unionByName(documents(spark, [f"{b} more"])).withColumn("doc_id", F.when(F.col("doc_id") == 1, None).otherwise(F.col("doc_id")))
    got = Counter((r["doc_id"], r["n_removed"], r["kept"]) for r in sub.substring_dedup(docs).collect())
    assert got[(None, 0, b)] == 1 and got[(0, 0, a)] == 2 and got[(0, 50, "more")] == 1
