"""The encoder's cache holds the words of the given tables (416,541 different ones at sf 0.1)."""

from __future__ import annotations

import pyarrow as pa

from castwise.llm.queries import tokenizer_path
from castwise.llm.word_tokens import WordEncoder


def test_words_are_not_forgotten_between_slices():
    coder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(4))
    for at in range(0, 300_000, 100_000):
        coder.encode(pa.array([" ".join(word(i) for i in range(at, at + 100_000))]))
    coder.encode(pa.array(["z"]))
    assert word(5).encode() in coder.cache
