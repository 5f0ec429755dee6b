"""The trie of conversations against a plain one built in Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from castwise.llm.prefix_trie import EMPTY, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, node long, x string"


def rebuilt_by_rule(rows, block=100, heads=6):
    """Turns of one number come in any order here, so tests give ties the same role and text."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = turns.get(c - c % block, [])[:h] + t[h:]
    return out


def trie_by_rule(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = set()
    for path in members:
        leaves = saved = 0
        todo = [path]
        while todo:
            p = todo.pop()
            leaves += not children[p]
            saved += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
            todo += children[p]
        digest = hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
        out.add((members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(children[path]), leaves, saved, digest))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in prefix_trie(*rebuilt(frame)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == trie_by_rule(rebuilt_by_rule(rows))
    return got


def test_trie_equals_a_plain_one(spark):
    rng, rows = random.Random(3), []
    for c in [*range(230), 900, 1203]:  # 900 lends to none, 1203 has no 1200
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c, turn * 2, rng.choice(["user", "bot"]) if turn > 2 else "user", rng.choice(["a", "b", "", "ñ😀"])))
    got = check(spark, rng.sample(rows, len(rows)))
    assert max(r[1] for r in got) > 8


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, "first"), (0, 1, "a", None), (0, 1, "a", None), (7, 0, None, None), (7, 0, "", ""), (8, 0, "", None), (-150, 0, "u", "t")]
    check(spark, rows)


def test_one_conversation_with_most_turns_and_many_equal_ones(spark):
    long = [(5, i, "user", f"t{i % 3}") for i in range(700)]
    equal = [(c, i, "user", f"w{i}") for c in range(100, 200) for i in range(7)]
    got = check(spark, long + equal)
    assert max(r[1] for r in got) > 650 and max(r[3] for r in got) > 100


def test_turnless_and_empty(spark):
    rows = [(c, 0, "u", "t") for c in range(1000, 1010, 1) if zlib.crc32(str(c).encode()) % 6 and c % 100]
    got = check(spark, rows)  # no conversation 1000 here: all are turnless
    assert got == [(min(r[0] for r in rows), 0, None, len(rows), 0, 1, 0, hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest())]
    assert check(spark, []) == []


@pytest.mark.parametrize("block, heads", [(10, 3)])
def test_other_parameters(spark, block, heads):
    rows = [(c, i, "u", "same" if i < 2 else f"{c % 4}") for c in range(40) for i in range(4)]
    frame = spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA)
    got = {tuple(r) for r in prefix_trie(*rebuilt(frame, block, heads)).collect()}
    assert got == trie_by_rule(rebuilt_by_rule(rows, block, heads)) and any(r[7] == EMPTY for r in got)
