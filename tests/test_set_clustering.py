"""Clustering from casts as arrays is that of edges, and shuffles neither edges nor lists of neighbours."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from castwise import queries
from castwise.operators import graph
from castwise.sources import adapters


def sets_of(spark, kind: str):
    """Repeated casts, a hub, single characters, an empty cast, a play without pairs; with null in some."""
    rng = random.Random(8)
    name = str if kind == "string" else int
    rows = [(p, [name(c) for c in rng.sample(range(24), rng.randint(1, 5))]) for p in "pq" for _ in range(40)]
    rows += [rows[0], ("p", [name(0), *map(name, range(30, 40))]), ("p", [name(77)]), ("q", []), ("r", [name(3)]), ("r", [name(4), None]), ("q", [None])]
    rows += [("q", [name(50), name(c)]) for c in range(24)]
    return spark.createDataFrame(rows, f"play_id string, members array<{kind}>")


@pytest.mark.parametrize(("kind", "pairs", "some"), [("long", 1 << 22, 1 << 21), ("long", 70, 3), ("string", 40, 1)])
def test_sets_equal_edges(spark, monkeypatch, kind, pairs, some):
    """One group for a play, and groups of three of several colors, looked up in slices."""
    monkeypatch.setattr(graph, "PAIRS", pairs)
    monkeypatch.setattr(graph, "SLICE", some)
    sets = sets_of(spark, kind)
    cast = sets.withColumn("seg_id", F.monotonically_increasing_id()).select("play_id", "seg_id", F.explode("members").alias("char_id")).localCheckpoint()
    want = graph.clustering(cast.select("play_id", "char_id").distinct(), graph.static_edges(graph.pairs(cast), ids=False))
    got = graph.set_clustering(sets)
    assert dict(got.dtypes) == dict(want.dtypes)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted(want.select(got.columns).collect(), key=key)
    assert sorted(got.collect(), key=key) == want and sum(r["triangles"] for r in want) > 300


def test_each_triangle_once(monkeypatch):
    monkeypatch.setattr(graph, "SLICE", 2)
    a, b = np.triu_indices(7, 1)
    found = [tuple(sorted(t)) for ends in graph.edge_triangles(a, b, 7) for t in np.stack(ends, axis=1).tolist()]
    assert len(found) == len(set(found)) == 35
    assert not list(graph.edge_triangles(a[:0], b[:0], 0))


def test_order_sets_are_the_cast(spark):
    d = "/root/testdata/sf0.001"
    want = adapters.order_cast(spark, d).groupBy("play_id", "seg_id").agg(F.sort_array(F.collect_set("char_id")).alias("m"))
    got = adapters.order_sets(spark, d).select("play_id", F.sort_array("members").alias("m"))
    assert sorted(got.collect()) == sorted(want.select("play_id", "m").collect())


def test_average_clustering_shuffles_no_edges(spark):
    """Casts go to the groups, characters to their sums and plays to their means; before, edges and a list of neighbours over each were shuffled."""
    plan = queries.average_clustering(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "array_intersect" not in plan
