from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from castwise.llm import pii
from tests.llm.test_operators import documents, prose

MAIL = re.compile(r"[a-z0-9]+@[a-z]+\.example")


def corpus(rng):
    """Values that recur with their own words, words that come with any value, copies, and texts without values."""
    out = []
    for i in range(24):
        who = i % 4
        out.append(f"{prose(rng, 25)} {prose(rng, 1, f'person{who}')} {prose(rng, rng.randint(1, 9))} u{who}@mail.example {prose(rng, 20)}")
    out += [f"{prose(rng, 15)} contact q{i}@mail.example {prose(rng, 20)}" for i in range(12)]
    out += [f"{prose(rng, 30)} {rng.choice(['person1', 'person2', 'contact', 'plain'])} {prose(rng, 10)}" for _ in range(12)]
    out += [prose(rng, 40) for _ in range(120)]
    return out + out[:10] + out[:3]


def by_rule(texts):
    """(value or 'email', term): disclosure, counted text by text; no two distinct texts here are near copies."""
    own = [(set(re.findall(r"[^\W_]+", t.lower())), set(MAIL.findall(t))) for t in sorted(set(texts))]
    n, out = len(own), {}
    for e in {v for _, vs in own for v in vs} | {"email"}:
        holds = [ts for ts, vs in own if (vs if e == "email" else e in vs)]
        if len(holds) < pii.SUPPORT or len(holds) == n or (e != "email" and len(holds) > pii.PUBLIC * n):
            continue
        p = len(holds) / n
        for t in set().union(*holds):
            both, df = sum(t in ts for ts in holds), sum(t in ts for ts, _ in own)
            score = 1 + math.log((both + pii.PRIOR * p) / (df + pii.PRIOR)) / -math.log(p)
            if both >= pii.SUPPORT and score >= pii.GENERALISE:
                out[e, t] = score
    return out


def test_disclosure_is_the_rule(spark):
    texts = corpus(random.Random(21))
    docs = documents(spark, texts)
    want = by_rule(texts)
    told = pii.disclosing_terms(pii.scanned(docs), pii.frequencies(docs)).collect()
    names = sorted({e for e, _ in want} | {v for t in texts for v in MAIL.findall(t)})
    entity = {r["h"]: r["e"] for r in spark.createDataFrame([(e,) for e in names], "e string").selectExpr("e", "xxhash64(0, e) h").collect()} | {0: "email"}
    term = {r["h"]: r["t"] for r in spark.createDataFrame([(t,) for t in sorted({w for x in texts for w in re.findall(r"[^\W_]+", x.lower())})], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    got = {(entity[r["entity"]], term[r["term"]]): r["disclosure"] for r in told}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert ("u0@mail.example", "person0") in want and any(e == "email" for e, _ in want)


def test_terms_of_a_value_go_wherever_they_stand(spark):
    rng = random.Random(22)
    texts = [f"{prose(rng, 25)} zorro {prose(rng, 5)} z@mail.example {prose(rng, 20)}" for _ in range(6)] + [prose(rng, 40) for _ in range(100)] + [f"{prose(rng, 20)} Zorro, {prose(rng, 20)}"]
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(documents(spark, texts)).collect()}
    assert "orro" not in got[0] and "orro" not in got[106] and all(got[i] == texts[i] for i in range(6, 106))


def test_near_copies_are_one_source(spark):
    rng = random.Random(23)
    base = f"{prose(rng, 60)} zorro z@mail.example {prose(rng, 60)}".split()
    texts = []
    for _ in range(40):
        w = list(base)
        for at in rng.sample(range(50), 3):
            w[at] = prose(rng, 1)
        texts.append(" ".join(w))
    docs = documents(spark, texts + [prose(rng, 40) for _ in range(500)])
    assert sum(r["n_term"] for r in pii.pii_spans(docs).collect()) == 0


def test_long_texts(spark):
    texts = ["w" * 80000 + " a.b@c.de", "1" * 80000, "a@b.co " * 20000, "x@y.com%foo@bar.de a@b_c@d.e", "+1(" * 20000, "a@" * 30000, "k" * 30000 + "@" + "d" * 30000]
    got = {r["doc_id"]: r for r in pii.pii_spans(documents(spark, texts)).collect()}
    assert got[0]["spans"] == "email:80001:80009" and got[2]["n_email"] == 20000 and got[2]["spans"].endswith("email:139993:139999")
    assert got[3]["spans"] == "email:0:7,email:7:18,email:21:28" and all(got[i]["n_spans"] == 0 for i in (1, 4, 5, 6))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(documents(spark, texts)).collect()}
    assert clean[2] == "<EMAIL> " * 20000 and clean[3] == "<EMAIL><EMAIL> a@<EMAIL>" and clean[1] == texts[1]


def test_secrets_and_the_words_that_tell_them(spark):
    rng = random.Random(24)
    hexa = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    secrets = [hexa() for _ in range(8)]
    texts = [f'{prose(rng, 30)} token = "{s}" {prose(rng, 20)}' for s in secrets] + [prose(rng, 60) for _ in range(200)] + ["a1" * 30, "abcdefghij" * 5, "token of thanks"]
    got = pii.sanitised(documents(spark, texts)).orderBy("doc_id").collect()
    assert all(s not in r["text"] and "<SECRET>" in r["text"] and "token" not in r["text"] for s, r in zip(secrets, got, strict=False))
    assert [r["text"] for r in got[8:]] == texts[8:]


def test_running_totals(spark):
    x = spark.createDataFrame([(list(range(1, n + 1)),) for n in (0, 1, 255, 256, 257, 1000)], "x array<int>")
    for r in x.select("x", pii.running(F.col("x"), lambda a, b: a + b).alias("s"), pii.running(F.reverse("x"), F.least).alias("m")).collect():
        assert r["s"] == [i * (i + 1) // 2 for i in r["x"]] and r["m"] == r["x"][::-1]


def test_small_tables_and_copies_switch_nothing_off(spark):
    """A value of a few texts is protected in a table of a dozen, and a group of copies of one of them changes nothing."""
    rng = random.Random(40)
    held = [f"{prose(rng, 25)} zanzibar {prose(rng, 5)} write to ann.lee@mail.example {prose(rng, 25)}" for _ in range(4)]
    other = [prose(rng, 60) for _ in range(8)]
    for copies in (1, 40):
        texts = [*held, *[held[0] + f" no{i}" for i in range(copies - 1)], *other]
        rows = pii.pii_spans(documents(spark, texts), prior=0.1).collect()
        told = {r["doc_id"]: r["spans"] for r in rows}
        for i in range(4):
            at = texts[i].index("zanzibar")
            assert f"term:{at}:{at + 8}" in told[i], copies
        assert all("term" not in told[i] for i in range(len(texts) - 8, len(texts)))


def test_the_rule_is_a_parameter(spark):
    rng = random.Random(41)
    texts = [f"{prose(rng, 25)} zanzibar write to ann.lee@mail.example {prose(rng, 25)}" for _ in range(4)] + [prose(rng, 60) for _ in range(8)]
    count = lambda **rule: sum(r["n_term"] for r in pii.pii_spans(documents(spark, texts), **rule).collect())
    assert count(prior=0.1) >= 4 and count(prior=0.1, support=5) == 0 and count(prior=0.1, generalise=1.1) == 0
