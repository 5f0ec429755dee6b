"""Numbers, ranks and running sums over whole tables against Python's sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from castwise.operators.order import numbered, ranked, running

ROWS = [(i, random.Random(i).choice([None, 1, 1, 1, 2, 5, 9]), random.Random(-i).randint(0, 4) or None) for i in range(500)]
LOW = lambda v: (v is not None, v or 0)  # noqa: E731  nulls first


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, a long, w long").repartition(3)


def test_numbered(rows):
    got = {r["id"]: r["place"] for r in numbered(rows, F.desc_nulls_first("a"), "id").collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(ROWS, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0])), 1)}


def test_numbers_of_ties_are_spread(rows):
    out = numbered(rows.drop("id", "w"), "a", name="n", spread=True)
    got = sorted((r["n"], r["a"]) for r in out.collect())
    assert got == [(i, r[1]) for i, r in enumerate(sorted(ROWS, key=lambda r: LOW(r[1])), 1)]


def test_running(rows):
    got = {r["id"]: (r["s"], r["f"]) for r in running(rows, ["a", "id"], {"s": "w", "f": F.col("w") * 0.5}).collect()}
    total, want = 0, {}
    for i, _, w in sorted(ROWS, key=lambda r: (LOW(r[1]), r[0])):
        want[i] = (total, total / 2)
        total += w or 0
    assert got == want


@pytest.mark.parametrize("dense", [False, True])
def test_ranked(rows, dense):
    got = {r["id"]: r["r"] for r in ranked(rows, ["a", "w"], "r", dense=dense).collect()}
    keys = sorted(((r[1], r[2]) for r in ROWS), key=lambda k: (LOW(k[0]), LOW(k[1])))
    keys = list(dict.fromkeys(keys)) if dense else keys
    assert got == {r[0]: keys.index((r[1], r[2])) + 1 for r in ROWS}


def test_empty(spark):
    none = spark.createDataFrame([], "a long, w long")
    assert numbered(none, "a").count() == running(none, ["a"], {"s": "w"}).count() == ranked(none, ["a"]).count() == 0


def test_no_task_sees_all_rows(rows, capsys):
    for out in (numbered(rows, "a", "id"), ranked(rows, ["a"], dense=True), running(rows, ["a", "id"], {"s": "w"})):
        out.explain("formatted")
        assert "SinglePartition" not in capsys.readouterr().out


WANTED = {"s": ("sum", "w"), "l": ("last", "w"), "n": ("next", "w"), "p": ("lag", "w"), "q": ("lead", "w")}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_scans_of_long_groups_equal_windows(spark, partitions):
    from castwise.operators.order import scanned

    rng = random.Random(5)
    rows = [(None if g == 2 else "abcde"[g], i, rng.choice([None, None, i, 0])) for i, g in enumerate(rng.choices(range(5), [90, 5, 3, 1, 1], k=900))]
    frame = spark.createDataFrame(rows, "g string, i long, w long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, want = (sorted(map(tuple, scanned(frame, ["g"], ["i"], WANTED, long).collect()), key=lambda r: r[1]) for long in (True, False))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    own = [r for r in got if r[0] == "a"]
    for k, (_, i, _, s, last, following, lag, lead) in enumerate(own):
        ws = [r[2] for r in own]
        assert s == sum(w or 0 for w in ws[:k]) and lag == (ws[k - 1] if k else None) and lead == (ws[k + 1] if k + 1 < len(ws) else None)
        assert last == next((w for w in reversed(ws[:k]) if w is not None), None) and following == next((w for w in ws[k + 1 :] if w is not None), None)


def test_scans_by_two_columns_and_of_nothing(spark):
    from castwise.operators.order import scanned

    frame = spark.createDataFrame([("a", i % 3, i, float(i)) for i in range(60)], "g string, h int, i int, w double").repartition(4)
    got, want = (sorted(map(tuple, scanned(frame, ["g", "h"], ["i"], WANTED, long).collect())) for long in (True, False))
    assert got == want
    assert scanned(frame.where("false"), ["g"], ["i"], WANTED, True).count() == 0
