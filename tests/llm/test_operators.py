from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from castwise.llm import boosted_trees as trees
from castwise.llm import imatch as im
from castwise.llm import packing, pii, simhash, topk
from castwise.llm.licenses import align, increasing, license_scan, scan, words
from castwise.llm.line_dedup import deduplicated, line_dedup
from castwise.llm.pieces import MergeEncoder, sentencepiece_round_trip
from castwise.llm.queries import tokenizer_path
from castwise.llm.token_files import token_files
from castwise.llm.word_tokens import WordEncoder

WORD, PIECE = "word_bpe_49k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "\n\n", "a", "a  b\n\n  c ", "▁x ▁", "日本語 text　x", "x\x00y", "<s> </s> <|endoftext|> <|ENDOFTEXT|>", "don't WE'LL 3rd 42", "é ñ ßÿ Ω😀", "\t\ta\r\nb", "ẖ H̱ İΣ", "w" * 3000, "the cat " * 4000]
#: Columns whose names the operators use inside.
CLASH = {"th": 1, "rank": 2, "_key": 3, "runs": 4, "_row": 5, "spans": 6, "hashes": 7, "n_chars": 8, "lang": "x"}


def documents(spark, texts, first=0):
    rows = [(first + i, t, *CLASH.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in CLASH.items()))


def prose(rng, n, start=""):
    return " ".join([*start.split(), *("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))])


def edge_rows(spark):
    """Nulls in any column, repeated rows, ties, empty and long texts."""
    d = documents(spark, ODD)
    return d.unionByName(d.where("doc_id = 5")).unionByName(d.withColumn("doc_id", F.lit(None).cast("long")).where("text = 'a'")).unionByName(d.select("doc_id", "text", *(F.lit(None).cast(d.schema[c].dataType).alias(c) for c in CLASH)).where("doc_id = 4"))


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 0), (3, 1, None), (4, None, 0), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "lines": lambda s, d: line_dedup(d),
    "lines_stage": lambda s, d: deduplicated(d),
    "imatch": lambda s, d: im.imatch(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "simhash_stage": lambda s, d: simhash.drop_near_duplicates(d),
    "licenses": lambda s, d: license_scan(d),
    "token_files": lambda s, d: token_files(d, tokenizer_path(WORD), 2),
    "quality": lambda s, d: trees.quality_scores(d, labels(s)),
    "quality_stage": lambda s, d: trees.drop_low_quality(d, labels(s)),
    "packing": lambda s, d: packing.pack(d, tokenizer_path(WORD), 1),
    "sentencepiece": lambda s, d: sentencepiece_round_trip(d, tokenizer_path(PIECE)),
    "pii": lambda s, d: pii.pii_spans(d),
    "pii_stage": lambda s, d: pii.sanitised(d),
}
PER_ROW = {"lines", "imatch", "simhash", "token_files", "quality", "sentencepiece", "pii", "pii_stage"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    docs = edge_rows(spark)
    got = OPERATORS[name](spark, docs)
    rows = got.collect()  # all columns are made, not only counted
    if name in PER_ROW:
        ids = [r["doc_id"] for r in rows]
        assert Counter(ids) == Counter(r["doc_id"] for r in docs.collect())
        told = {}
        for r in rows:  # equal texts get equal results, whatever their other columns
            if name in ("simhash", "quality", "sentencepiece", "pii") and r["doc_id"] in (4, None):
                told.setdefault("a", set()).add(tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "component_id", "held_out")))
        assert all(len(v) == 1 for v in told.values())
    if name.endswith("stage"):
        assert got.columns == docs.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](spark, documents(spark, ["x"]).where("doc_id < 0")).count() == 0


def lines_by_rule(texts, least=5):
    """Every line in a run of at least ``least`` words that occurs earlier goes."""
    own = [[(k, " ".join(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()] for t in texts]
    seen, out = {}, []
    runs = [(d, i, j, tuple(x for _, x in own[d][i:j])) for d in range(len(own)) for i in range(len(own[d])) for j in range(i + 1, len(own[d]) + 1)]
    for d, i, _, r in runs:
        seen.setdefault(r, (d, i))
    for d, t in enumerate(texts):
        gone = {k for x, i, j, r in runs if x == d and sum(len(s.split()) for s in r) >= least and seen[r] < (d, i) for k in range(own[d][i][0], own[d][j - 1][0] + 1)}
        out.append(t if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone))
    return out


def test_line_dedup_is_the_rule(spark):
    rng = random.Random(1)
    pool = [prose(rng, k) for k in (1, 1, 2, 3, 5, 9)]
    texts = ["\n".join(rng.choices([*pool, ""], k=rng.randint(0, 7))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup(documents(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == lines_by_rule(texts)


def test_passages_go_and_clean_lines_stay(spark):
    rng = random.Random(2)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}" for _ in range(5)] + [prose(rng, 40) for _ in range(3)]
    got = [r["text"] for r in line_dedup(documents(spark, texts)).orderBy("doc_id").collect()]
    assert sum(passage in t for t in got) == 1 and [t.replace(passage + "\n", "") for t in texts[1:]] == got[1:]


def test_imatch(spark):
    rng = random.Random(3)
    common = [prose(rng, 1) for _ in range(300)]
    texts = [" ".join(rng.choices(common, k=120)) for _ in range(60)]
    texts[7] = texts[3]
    got = im.imatch(documents(spark, texts), low=0.01, high=0.9).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        nxt = texts[i - 1] if i else texts[-1]
        k = len(texts[i]) // 3
        assert r["edited_sha256"] == hashlib.sha256((texts[i][: len(texts[i]) - k] + nxt[:k]).encode()).hexdigest() and r["n_chars"] == len(texts[i])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[7]["fingerprint"] == got[3]["fingerprint"]
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 50


def fingerprint_by_rule(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_rule(fps, radius=3):
    part = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return part


def test_simhash(spark):
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + [prose(rng, 80) for _ in range(10)]
    for i in range(40):
        w = texts[len(ODD) + i % 10].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    fps = [fingerprint_by_rule(t) for t in texts]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(documents(spark, texts)).collect()}
    part = classes_by_rule(fps)
    assert got == {i: (f"{f:016x}", part[i]) for i, f in enumerate(fps)}
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(documents(spark, texts)).collect())
    assert kept == sorted(set(part))


def test_bk_tree_and_hot_shards(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    points = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(200)})
    tree = simhash.BKTree(points)
    for p in points[:20]:
        want = sorted(q for q in points if (p ^ q).bit_count() <= 3)
        assert sorted(tree.points[i] for i in tree.within(p, 3)) == want
        q = np.array([p], np.uint64)
        assert sorted(tree.points[i] for _, at in simhash.search(tree.flat(), q[:, None], 3) for i in at.tolist()) == want
    monkeypatch.setattr(simhash, "SHARD", 16)  # many pieces
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    from castwise.llm.components import components

    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    order = sorted(range(len(points)), key=lambda i: signed[i])
    part = classes_by_rule([points[i] for i in order])
    assert [got.get(signed[i], signed[i]) for i in order] == [signed[order[p]] for p in part]


def test_alignment():
    assert increasing([3, 1, 2, 5, 4]) == [1, 2, 4] and increasing([]) == []
    assert [j for _, j in align("x the a b y c the z".split(), "the a b c the".split())] == [0, 1, 2, 3, 4]
    template = words("Released under the MIT License.")
    assert scan(words("so it is. Released under an MIT license, and more"), template) == [(3, 8, 0.8)]
    assert scan(words("under the sea the license was released"), template) == []
    assert len(scan(words("Released under the MIT License. " * 3), template)) == 3


def test_license_scan(spark):
    got = license_scan(documents(spark, ["a b Licensed under the Apache License, Version 2.0. c", "nothing here", "This work is licensed under the GNU General Public License, version 3."])).collect()
    assert {(r["doc_id"], r["license"], r["coverage"]) for r in got} == {(0, "Apache-2.0", 1.0), (2, "GPL-3.0", 1.0)}


def test_word_encoder_is_the_library():
    e = WordEncoder(tokenizer_path(WORD))
    ids, ends = e.encode(pa.array(ODD))
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    for t in ODD:  # word by word, not by the fallback for a whole slice
        assert [i for w in (t or "").encode().split() for i in np.frombuffer(e._units([w])[0], e.dtype).tolist()] == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_token_files(spark):
    e = WordEncoder(tokenizer_path(WORD))
    got = {r["doc_id"]: r for r in token_files(documents(spark, ODD), tokenizer_path(WORD), 2).collect()}
    at = 0
    for i, t in enumerate(ODD):
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_trees_learn_and_score(spark):
    rng = random.Random(6)
    good = [prose(rng, 60) + "." for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(50)]
    docs = documents(spark, [*good, *bad, None, ""])
    marks = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = trees.quality_scores(docs, marks).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] < 200:
            assert r["predicted"] == int(r["doc_id"] < 150)
    assert trees.drop_low_quality(docs.where("doc_id < 200"), marks).count() == 150
    none = trees.quality_scores(docs, marks.where("doc_id < 0"))
    assert {r["predicted"] for r in none.collect()} == {1}


def test_packing(spark):
    e = WordEncoder(tokenizer_path(WORD))
    rng = random.Random(7)
    texts = [*ODD, *(prose(rng, rng.choice([3, 40, 200, 900])) for _ in range(40))]
    rows = packing.pack(documents(spark, texts), tokenizer_path(WORD), 1, 2048).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used += at
    assert len(seq) <= used / 2048 * 1.02 + 1.5


def test_patterns_pack_exactly():
    rng = random.Random(8)
    demand = Counter(rng.choice([3, 5, 7, 20, 31, 64]) for _ in range(500))
    made, cuts = packing.patterns(dict(demand), 64)
    assert not cuts
    got = Counter()
    for times, items in made:
        assert sum(s * a for s, a in items.items()) <= 64
        for s, a in items.items():
            got[s] += times * a
    assert got == demand
    assert sum(t for t, _ in made) <= sum(s * n for s, n in demand.items()) / 64 * 1.03 + 1


def test_cuts_only_where_they_save():
    fits, cuts = packing.patterns({32: 100, 64: 10}, 64, section=16)  # nothing to save
    assert not cuts and sum(t for t, _ in fits) == 60
    made, cuts = packing.patterns({40: 100}, 64, section=16)  # whole, each would leave 24
    got = Counter({40: 100})
    for times, size, where in cuts:
        got.update({size: -times, where: times, size - where: times})
    packed = Counter()
    for times, items in made:
        assert sum(s * a for s, a in items.items()) <= 64
        for s, a in items.items():
            packed[s] += times * a
    assert +packed == +got and cuts and sum(t for t, _ in made) <= 4000 / 64 * 1.05 + 2


def test_few_documents_are_cut(spark):
    rng = random.Random(17)
    docs = documents(spark, [prose(rng, rng.randint(1, 500)) for _ in range(400)])
    rows = packing.pack(docs, tokenizer_path(WORD), 1, 2048).collect()
    of = Counter(r["doc_id"] for r in rows)
    short = {r["doc_id"] for r in rows if r["doc_tokens"] <= 2048}
    assert sum(of[d] > 1 for d in short) < 0.25 * len(short)
    used = sum(r["length"] for r in rows)
    assert 1 + max(r["sequence_id"] for r in rows) <= used / 2048 * 1.02 + 1.5


@pytest.mark.parametrize("high", [2, 40, 10**9])
def test_threshold_algorithm(high):
    rng = np.random.default_rng(9)
    x = rng.integers(-high, high, (300, 6))
    x[50:60] = x[0]
    ids = np.arange(300) * 3
    q, qi = x[::20], ids[::20]
    score, place = topk.threshold_top_k(q, qi, x, ids, 20)
    for row, (v, own) in enumerate(zip(q.tolist(), qi.tolist(), strict=True)):
        want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for w, i in zip(x.tolist(), ids.tolist(), strict=True) if i != own)[:20]
        got = sorted((-s, ids[p]) for s, p in zip(score[row].tolist(), place[row].tolist(), strict=True))
        assert got == want


def test_top_k_rows(spark):
    rows = [(i, [float(i % 7), -1.0, i / 100]) for i in range(60)] + [(None, [1.0, 1.0, 1.0]), (61, None), (62, [1.0, None, 1.0]), (63, [float("nan"), 1.0, 1.0]), (64, [1.0, 1.0]), (5, [5.0, -1.0, 0.05])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)), k=70).collect()
    assert Counter(r["query_id"] for r in got) == {0: 59, 20: 59, 40: 59}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_sentencepiece_is_the_library(spark):
    m = MergeEncoder(tokenizer_path(PIECE))
    ids, said = m.encode(pa.array(ODD))
    assert ids == [m.library.encode(t or "") for t in ODD] and said == [",".join(map(str, x)).encode() for x in ids]
    for unit in ("▁hello", "x", "▁▁", "日本"):
        assert m.agendas([unit], 8)[0] == m.agenda(unit)
    got = {r["doc_id"]: r for r in sentencepiece_round_trip(documents(spark, ODD), tokenizer_path(PIECE), with_results=True).collect()}
    for i, t in enumerate(ODD):
        back = m.library.decode(m.library.encode(t or ""))
        assert got[i]["decoded"] == back and got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest() and got[i]["n_tokens"] == len(ids[i])


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
PRIVATE = ["a.b@c.d x@y é me@host.co.uk", "ip 1.2.3.4 001.255.0.9 256.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111", "call +1 (017) 555-7713 or +12", "😀 +49 30 123456 a@b.c 10.0.0.1", "9" * 5000, "1.2.3.4" * 50, *(t or "" for t in ODD)]


def test_pii_base_is_the_contract(spark):
    got = {r["doc_id"]: r for r in pii.pii_spans(documents(spark, PRIVATE)).collect()}
    for i, t in enumerate(PRIVATE):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, t) if ok(m.group())]
        assert got[i]["spans"].startswith(",".join(spans)) and got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_pii_terms_and_sanitising(spark):
    rng = random.Random(10)
    texts = [f"{prose(rng, 12)} captain Zyx{i % 1} wrote z@ship.example to {prose(rng, 12)}" for i in range(6)] + [f"{prose(rng, 20)} q{i}@w.example {prose(rng, 5)}" for i in range(20)] + [prose(rng, 30) for _ in range(60)]
    docs = documents(spark, texts)
    got = pii.pii_spans(docs).orderBy("doc_id").collect()
    assert all(r["n_term"] > 0 for r in got[:6]) and all(r["n_term"] == 0 for r in got[6:])
    clean = {r["doc_id"]: r for r in pii.sanitised(docs).collect()}
    for i in range(6):
        assert "z@ship" not in clean[i]["text"] and "<EMAIL>" in clean[i]["text"] and "Zyx" not in clean[i]["text"] and clean[i]["n_chars"] == len(clean[i]["text"])
    assert all(clean[i]["text"] == texts[i] for i in range(26, 86))
