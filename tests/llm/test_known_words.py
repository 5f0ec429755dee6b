"""Words that a worker knows: more of them than before are kept, and all of a slice are looked up at once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from castwise.llm.pieces import MergeEncoder
from castwise.llm.queries import tokenizer_path
from castwise.llm.word_tokens import WordEncoder
from castwise.llm.words import Known


def odd_texts(parts, n=3000):
    rng = random.Random(1)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", " ", "\n", " \n "]


def test_words_beyond_half_a_million_are_kept():
    known = WordEncoder(tokenizer_path("word_bpe_49k.json")).cache
    assert known.most >= 1_000_000
    ones = lambda new: (np.ones(len(new), np.int64), np.arange(len(new)), np.ones(len(new), np.int64))
    for at in range(0, 700_000, 100_000):
        known.codes(pa.array([str(i) for i in range(at, at + 100_000)]), ones)
    assert b"5" in known and len(known) == 700_000


def test_word_ids_of_odd_texts_are_the_library_s(monkeypatch):
    coder = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(coder, "_library", None)  # words alone must do
    texts = odd_texts(["a", "B", "é", "é", "́", "'", "'s", "<|endoftext|>", "<|", "!", " ", " ", "\x1c", "1", "K", "日", "😀", " ", "\n", "\t", "  ", "`", "[", "]", "\\", "~", "|", "."])
    for _ in range(2):  # learnt, then known
        ids, ends = coder.encode(pa.array(texts))
        assert all(ids[a:b].tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True))


def test_pieces_of_odd_texts_are_the_library_s():
    coder = MergeEncoder(tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts(["a", "B", "é", "́", "'", "!", " ", " ", "1", "日", "😀", "\n", "\t", "  ", "▁", "x1", "\r", "the"])
    for _ in range(2):
        ids, said = coder.encode(pa.array(texts))
        assert ids == [coder.library.encode(t or "") for t in texts] and said == [",".join(map(str, x)).encode() for x in ids]


def test_known_starts_anew_and_says_the_same():
    known, asked = Known(np.int32, 3), []

    def learn(new):
        asked.append(new.to_pylist())
        n = np.fromiter(map(len, asked[-1]), np.int64)
        return np.frombuffer("".join(asked[-1]).encode(), np.uint8), np.cumsum(n) - n, n

    for words in (["ab", "c", "ab"], ["c", "de", "fgh"], ["ab", ""]):
        code = known.codes(pa.array(words), learn)
        assert [bytes(known.flat[known.start[c] : known.start[c] + known.length[c]].tolist()).decode() for c in code] == words
    assert asked == [["ab", "c"], ["de", "fgh"], ["ab", ""]]
