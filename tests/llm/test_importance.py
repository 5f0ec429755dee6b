"""Importance resampling against plain CRCs and a plain sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from castwise.llm import importance as imp
from castwise.llm.words import word_codes
from tests.llm.test_operators import ODD, documents, edge_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text, max_n):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def by_rule(rows, target, max_n=1, buckets=10_000, min_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, max_n))
    t = Counter(bucket(f) for x in target for f in features(x, max_n))
    ns, nt = sum(s.values()), sum(t.values())
    out, able = {}, []
    for i, text in rows:
        own = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in map(bucket, features(text, max_n))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = (len(own), weight, score)
        if len(words_of(text)) >= min_words:
            able.append((-score, i))
    drawn = {i: r for r, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1)}
    return {i: (*v, drawn.get(i)) for i, v in out.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8"), max_size=12), max_size=8), max_size=5))
def test_runs_have_the_crcs_of_their_strings(texts):
    texts = [" ".join(t) for t in texts]
    codes, ends, words = word_codes(pa.array(texts, pa.string()), imp.TABLE)
    for n, (crcs, stops) in enumerate(imp.run_crcs(codes, ends, words, 4), 1):
        for i, text in enumerate(texts):
            w = words_of(text)
            assert crcs[stops[i] : stops[i + 1]].tolist() == [zlib.crc32(" ".join(w[a : a + n]).encode()) for a in range(len(w) - n + 1)]


@pytest.mark.parametrize("length", [0, 1, 2, 7, 31, 32, 33, 255, 4096, 1_000_003])
def test_shift_is_that_of_zero_bytes(length):
    crc = zlib.crc32(b"some words")
    joined = zlib.crc32(b"some words" + bytes(length))
    assert int(imp.shifted(np.array([crc], np.uint32), np.array([length]))[0]) ^ zlib.crc32(bytes(length)) == joined


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeXYZé", k=rng.randint(1, 4))) + rng.choice(["", ",", ". -"]) for _ in range(n))


@pytest.mark.parametrize("max_n", [1, 3])
def test_equals_the_rule(spark, max_n):
    rng = random.Random(max_n)
    rows = [*enumerate(prose(rng, rng.randint(0, 60)) for _ in range(300)), *((1000 + i, t) for i, t in enumerate(ODD))]
    target = [prose(rng, 50) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rank string").repartition(3)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, n long")
    out = imp.importance_scores(docs, goal, max_n=max_n, buckets=997)
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()}
    assert got == by_rule(rows, target, max_n, 997)
    drawn = {r["doc_id"] for r in imp.resampled(docs, goal, max_n=max_n, buckets=997).collect()}
    assert drawn == {i for i, v in got.items() if v[3]} and len(drawn) > 15


def test_edges(spark):
    docs = edge_rows(spark)
    goal = docs.select("text")
    got = imp.importance_scores(docs, goal, min_words=1, percent=100).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    ranks = sorted(r["rank"] for r in got if r["n_words"])
    assert ranks == list(range(1, len(ranks) + 1))
    assert all(r["weight"] == r["n_features"] == 0 and r["rank"] is None for r in got if not r["n_words"])
    none = docs.where("false")
    assert imp.importance_scores(none, goal).count() == 0
    assert imp.importance_scores(docs, none.select("text")).count() == docs.count()
    assert imp.resampled(docs, goal, min_words=1, percent=100).columns == docs.columns


def test_ties_and_a_document_repeated_many_times(spark):
    docs = documents(spark, ["one two " * 20] * 4).withColumn("doc_id", F.lit(7).cast("long"))
    docs = docs.crossJoin(spark.range(100).select(F.lit(1).alias("again")))
    got = imp.importance_scores(docs, docs.select("text"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201)) and len(got) == 400
