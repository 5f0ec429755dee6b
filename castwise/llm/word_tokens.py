"""Token ids of whole texts by a ``tokenizers`` file with a word-end BPE (op5, op7).

The pre-tokenizer of such a file never joins characters over white space, so a text's
ids are the ids of its white-space-separated words one after another.  Texts are split
and their words looked up by Arrow's kernels; only words not seen before go to the
library, and ids are gathered with numpy.  One whole text of every slice is also encoded by the
library as it stands; should it ever differ, the slice is done by the library alone.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import by_document, gather
from .words import Known

#: Distinct words that a worker remembers; beyond it starts anew (a cache: results don't depend on it).
CACHE_WORDS = 1_000_000

#: Of each slice, the text nearest to this many bytes is encoded whole as well.
PROBE = 2000

#: Words that go to the library as one text.
TOGETHER = 256

_ASCII_WORD = r"^(?P<letters>[a-z]+)(?P<marks>[!-&(-/:;=-@\[-`{}~]*)$"  # ASCII punctuation but ' < |


class WordEncoder:
    """encode(array of strings) -> (ids as one numpy array, ends of the texts with a leading 0)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cache = Known(self.dtype, CACHE_WORDS)
        self.plain = Known(self.dtype, CACHE_WORDS)

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A run of a-z, or of punctuation, is one pre-token that the normalizer leaves as it is."""
        ids = [[t.id for t in self.model.tokenize(r)] if r else [] for r in runs.to_pylist()]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), self.dtype, int(length.sum())), np.cumsum(length) - length, length

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word; TOGETHER words are one text, whose ids are told apart by where they begin."""
        ids, length = [], [np.empty(0, np.int64)]
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            of = np.searchsorted(starts, [a for a, _ in e.offsets], side="right") - 1
            ids += e.ids
            length.append(np.bincount(of, minlength=len(part)))
        return np.array(ids, self.dtype), np.concatenate(length)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = pc.extract_regex(pc.ascii_lower(words), _ASCII_WORD)
        plain = np.asarray(pc.is_valid(cut).to_numpy(zero_copy_only=False))
        both = pa.chunked_array([pc.struct_field(cut, "letters").drop_null(), pc.struct_field(cut, "marks").drop_null()]).combine_chunks()
        code = self.plain.codes(both, self._runs).reshape(2, -1).T.ravel()  # letters and marks of one word after another
        flat, n = gather(code, self.plain.start, self.plain.length, self.plain.flat)
        rest, m = self._joined(words.filter(pa.array(~plain)).to_pylist())
        start, length = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        length[plain], length[~plain] = n.reshape(-1, 2).sum(1), m
        start[plain], start[~plain] = np.cumsum(length[plain]) - length[plain], np.cumsum(m) - m + len(flat)
        return np.concatenate((flat, rest)), start, length

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids or [np.empty(0, self.dtype)]), np.cumsum([0, *map(len, ids)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        code = self.cache.codes(words.flatten(), self._words)
        ids, n = gather(code, self.cache.start, self.cache.length, self.cache.flat)
        ends = by_document(words, n)
        size = np.asarray(pc.binary_length(texts).fill_null(0))
        probe = int(np.argmin(np.where(size > 0, np.abs(size - PROBE), 1 << 40))) if len(size) else 0
        if len(size) and size[probe] > 0:
            whole = self.tokenizer.encode(texts[probe].as_py(), add_special_tokens=False).ids
            if whole != ids[ends[probe] : ends[probe + 1]].tolist():
                return self._library([t or "" for t in texts.to_pylist()])
        return ids, ends


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker and file."""
    return WordEncoder(path)
