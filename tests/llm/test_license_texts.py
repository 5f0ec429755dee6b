from __future__ import annotations

import random

from castwise.llm.licenses import TEXTS, license_scan
from tests.llm.test_operators import documents, prose


def test_texts_and_notices_are_found_as_themselves(spark):
    rng = random.Random(15)
    names = list(TEXTS)
    texts = [f"{prose(rng, 30)}\n{TEXTS[n]}\n{prose(rng, 30)}" for n in names] + [prose(rng, 200)]
    rows = license_scan(documents(spark, texts)).where("license like '%-text' or license like '%-notice'").collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in rows) == [(i, n, 1.0) for i, n in enumerate(names)]
