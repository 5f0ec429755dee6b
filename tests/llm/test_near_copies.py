from __future__ import annotations

import random

import pytest

import corpus_pipeline
from castwise.llm import near_copies
from tests.llm.test_operators import CLASH, ODD, documents, edge_rows, prose


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_rule(texts, similarity=0.8):
    """Places of the first text of each component, all pairs compared."""
    sets, part = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            near = len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9
            if near and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return sorted(set(part))


def planted(rng):
    """Texts with exact copies and copies with 1 to 12 words changed, some changed again."""
    texts = [prose(rng, rng.choice([8, 60, 150, 300])) for _ in range(20)]
    for i in range(80):
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 12])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("piece", [1 << 19, 600])
def test_stage_finds_what_brute_force_finds(spark, monkeypatch, piece):
    monkeypatch.setattr(near_copies, "PIECE", piece)  # small: many pieces
    texts = [*ODD, *planted(random.Random(11))]
    got = corpus_pipeline.near_duplicates(spark, documents(spark, texts), None)
    want = kept_by_rule(texts)
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert 16 < len(want) < len(texts) - 30


def test_common_passage_links_nothing(spark):
    rng = random.Random(12)
    passage = prose(rng, 60)
    texts = [f"{passage} {prose(rng, 80)}" for _ in range(30)]
    assert near_copies.drop_near_copies(documents(spark, texts)).count() == 30


def test_edges_of_the_stage(spark):
    got = near_copies.drop_near_copies(edge_rows(spark))
    assert got.columns == ["doc_id", "text", *CLASH] and got.count() == len(kept_by_rule(ODD))
    assert near_copies.drop_near_copies(edge_rows(spark).where("doc_id < 0")).count() == 0
