"""What has to grow in step with its input."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from castwise.operators import graph, segment


def folded(sets, said):
    """The speaking model's runs, one segment after another."""
    blocks, at = [], []
    for members, voices in zip(sets, said, strict=True):
        if not blocks or blocks[-1][0] != members:
            blocks.append([members, set()])
        blocks[-1][1] |= voices
        at.append(len(blocks) - 1)
    runs, run, last = [], 0, None
    for members, voices in blocks:
        crossing, heard = (set(), voices) if last is None else (crossers | (members ^ last), told | voices)
        cut = last is None or bool(members) != bool(last) or bool(crossing & heard)
        run, crossers, told, last = run + cut, set() if cut else crossing, set(voices) if cut else heard, members
        runs.append(run)
    return [runs[i] for i in at]


def test_speaking_fold_equals_one_step_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(segment, "STARTS", 3)
    rng, rows, spoken, want = random.Random(7), [], [], {}
    for p in range(12):
        now, sets, said = set(), [], []
        for i in range(rng.choice([1, 6, 150])):
            now = set() if rng.random() < 0.05 else now ^ {rng.choice("abcde")} if rng.random() < 0.7 else set(now)
            sets.append(now)
            said.append({c for c in "abcde" if rng.random() < 0.06})
            rows.append((f"p{p}", i + 1, sorted(now)))
            spoken += [(f"p{p}", i + 1, c) for c in said[-1]]
        want |= {(f"p{p}", i + 1): r for i, r in enumerate(folded(sets, said))}
    got = segment.speaking_fold(spark.createDataFrame(rows, "play_id string, seg_id long, members array<string>"), spark.createDataFrame(spoken, "play_id string, seg_id long, char_id string"))
    assert {(r["play_id"], r["seg_id"]): r["fold_id"] for r in got.collect()} == want


def test_speaking_fold_of_a_long_play(spark):
    """One play of 40,000 blocks: a state that holds all runs so far is copied at each (31 s on 8 cores)."""
    b, c, d, a = (F.lit(x) for x in "bcda")
    kind = F.col("id") % 4
    sets = spark.range(1, 40_001).select(F.lit("p").alias("play_id"), F.col("id").alias("seg_id"), F.when(kind == 1, F.array(a, b)).when(kind == 2, F.array(b)).when(kind == 3, F.array(b, c)).otherwise(F.array(b, c, d)).alias("members"))
    said = spark.range(1, 40_001).where("id % 4 = 0").select(F.lit("p").alias("play_id"), F.col("id").alias("seg_id"), F.lit("a").alias("char_id"))
    began = time.time()
    assert segment.speaking_fold(sets, said).agg(F.max("fold_id"), F.count("*")).first()[:] == (20_000, 40_000)
    assert time.time() - began < 20


def test_edges_are_made_from_different_casts(spark):
    """Segments of one cast are one row before pairs are made, and the edges are those of all segments."""
    rng = random.Random(3)
    casts = [sorted(rng.sample("abcdef", rng.randint(0, 4))) for _ in range(6)]
    rows = [(f"p{p}", i, rng.choice(casts), rng.randint(0, 9)) for p in range(2) for i in range(200)]
    segments = spark.createDataFrame(rows, "play_id string, seg_id long, members array<string>, word_count long")
    part_of = spark.createDataFrame([("p0", "b", "a"), ("p1", "c", "f")], "play_id string, part string, whole string")
    sets = graph.cast_sets(segments)
    assert sets.count() <= 2 * len(casts)
    pairs = graph.pairs(segments.select("play_id", "seg_id", F.explode("members").alias("char_id")), part_of)
    want = graph.static_edges(pairs, segments.select("play_id", "seg_id", "word_count"), ids=False)
    assert sorted(graph.set_edges(sets, part_of).collect()) == sorted(want.collect())
