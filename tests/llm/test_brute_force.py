"""Operators against plain rewritings of what their docstrings say."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from castwise.llm import boosted_trees as trees
from castwise.llm import imatch as im
from castwise.llm import topk
from castwise.llm.licenses import TELLING, TEMPLATES, TEXTS, align, license_scan, words
from castwise.llm.line_dedup import line_dedup, windows
from tests.llm.test_operators import documents, prose

HASH = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def imatch_by_rule(texts, low, high):
    term = lambda w: signed(HASH(w.encode()))
    own = [dict.fromkeys(term(w) for w in re.split(r"[\W_]+", (t or "").lower()) if w) for t in texts]
    once = {t or "": set(o) for t, o in zip(texts, own, strict=True)}
    n, df = len(once), {}
    for o in once.values():
        for t in o:
            df[t] = df.get(t, 0) + 1
    lexicon = {t for t, d in df.items() if d > 1 and max(2, low * n) <= d <= max(2, high * n)}

    def hashes(text, terms):
        used = set(terms) & lexicon
        if not used or len(used) < im.SPARSE * len(terms):
            used = set(terms)
        if not used:
            return [HASH(text.encode()) & 0xFFFFFFFF if text else None] * im.SUBSETS
        out = []
        for k, (parts, rate) in enumerate(im.SIZES):
            for j in range(parts):
                h, some = 42, sorted(t for t in used if (t >> 9 * k) % rate == j)
                for t in some:
                    h = HASH(t.to_bytes(8, "little", signed=True), h)
                out.append(h & 0xFFFFFFFF if some else None)
        return out

    def likeness(a, b):
        told = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in told) / len(told) if told else 1.0

    plain = [t or "" for t in texts]
    prints = [hashes(t, list(o)) for t, o in zip(plain, own, strict=True)]
    out = []
    for i, t in enumerate(plain):
        nxt = i - 1 if i else len(plain) - 1
        k = len(t) // 3
        edited = t[: len(t) - k] + plain[nxt][:k]
        other = hashes(edited, list(dict.fromkeys(term(w) for w in re.split(r"[\W_]+", edited.lower()) if w)))
        shown = lambda p: "".join("........" if h is None else f"{h:08x}" for h in p)
        out.append((shown(prints[i]), shown(other), likeness(prints[i], other), likeness(prints[i], prints[nxt])))
    return out


@pytest.mark.parametrize("few", [im.LEXICON, 0])
def test_imatch_is_the_rule(spark, monkeypatch, few):
    monkeypatch.setattr(im, "LEXICON", few)  # 0: the lexicon is joined by shuffle
    rng = random.Random(31)
    pool = [prose(rng, 1) for _ in range(400)]
    texts = [" ".join(rng.choices(pool, k=rng.randint(5, 150))) for _ in range(40)] + ["", None, "...", pool[0]]
    texts[9] = texts[4]
    got = {r["doc_id"]: r for r in im.imatch(documents(spark, texts), low=0.06, high=0.4).collect()}
    for i, (own, edited, near, following) in enumerate(imatch_by_rule(texts, 0.06, 0.4)):
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, edited)
        assert r["near_edited"] == pytest.approx(near) and r["near_next"] == pytest.approx(following)


def common(a, b):
    """Length of the longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_covers_gaps_without_unique_words():
    assert len(align("a b a b a b".split(), "b a b a".split())) == 4
    rng = random.Random(32)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        match = align(a, b)
        assert all(a[i] == b[j] for i, j in match) and all(x < y and u < v for (x, u), (y, v) in zip(match[:-1], match[1:], strict=True))


def test_edited_license_texts_are_found(spark):
    """Recall against the whole table: what a longest common subsequence covers to 0.85 is found, if the words that tell the license are left."""
    rng = random.Random(33)
    known = TEMPLATES | TEXTS
    texts, want = [], []
    for name in sorted(known):
        for rate in (0.0, 0.04, 0.1):
            own = words(known[name])
            kept = [w if rng.random() >= rate else rng.choice([prose(rng, 1), ""]) for w in own]
            kept = [w for w in kept if w]
            if common(kept, own) >= 0.85 * len(own) and set(TELLING[name][0].split()) <= set(kept):
                want.append((len(texts), name))
            texts.append(f"{prose(rng, 40)} {' '.join(kept)} {prose(rng, 40)}")
    got = {(r["doc_id"], r["license"]) for r in license_scan(documents(spark, texts)).collect()}
    rivals = {d for d, n in got}
    missed = [(d, n) for d, n in want if (d, n) not in got and d not in rivals]
    assert len(want) > 35 and not missed and len(set(want) & got) >= 0.9 * len(want)


def test_trees_are_walked_as_they_stand():
    rng = np.random.default_rng(34)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    model = trees.fit(x, y, trees=20)
    for row, score in zip(x, model.score(x), strict=True):
        total = model.base
        for at in model.root.tolist():
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_held_out_accuracy(spark):
    """On the given labels: rows that the classifier never saw."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = trees.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels.where("quality is not null"), "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 20 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


def test_rows_of_one_id_with_other_vectors(spark):
    rng = random.Random(35)
    rows = [(rng.randint(0, 40), [rng.uniform(-1, 1) for _ in range(3)]) for _ in range(120)]
    rows += rows[:5]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("rank")), k=7).collect())
    whole = {(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows}
    want = []
    for q in sorted({i for i, _ in whole if i % 20 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for j, u in whole if j == q for i, v in whole if i != q)[:7]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert got == want


def test_fewer_prints_than_lines():
    rng = random.Random(36)
    lines = [prose(rng, rng.randint(1, 3)) for _ in range(200)]
    assert len(windows("\n".join(lines).encode())) < 150


def test_long_texts_of_many_lines(spark):
    rng = random.Random(37)
    block = [prose(rng, 6) for _ in range(3000)]
    texts = ["\n".join(block), "\n".join([*block, "a new line of six words"]), "w" * 200000]
    got = line_dedup(documents(spark, texts)).orderBy("doc_id").collect()
    assert got[0]["text"] == texts[0] and got[1]["text"] == "a new line of six words" and got[1]["_removed"] == 3000 and got[2]["text"] == texts[2]
