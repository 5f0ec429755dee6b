"""Words of whole texts as codes, by Arrow's kernels: into the distinct words of a slice, or into all that a worker knows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(texts: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(a code per word, ends of the texts with a leading 0, the distinct words).

    Words are what lies between ASCII white space, after ``table`` (256 bytes, white space
    for what separates words) is applied to every byte.  A null text has none.
    """
    raw = pa.array(texts.cast(pa.binary()).fill_null(b"").to_pylist(), pa.binary())  # one buffer from 0 on
    data = raw.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    plain = pa.StringArray.from_buffers(len(raw), raw.buffers()[1], pa.py_buffer(data.translate(table) if table else data))
    lists = pc.ascii_split_whitespace(plain)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    codes, ends = np.asarray(coded.indices, dtype=np.int64), np.asarray(lists.offsets, dtype=np.int64)
    if b"" in words:  # at the ends of texts that begin or end with white space
        real = codes != words.index(b"")
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        codes = codes[real]
    return codes, ends - ends[0], words


class Known:
    """Strings and the numbers that belong to each; a cache, which starts anew beyond ``most`` strings or ``most_bytes`` of them.

    All strings of a slice are looked up at once in Arrow's hash table of the known ones.
    """

    def __init__(self, dtype, most: int, most_bytes: int = 1 << 26):
        self.dtype, self.most, self.most_bytes = np.dtype(dtype), most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.start, self.length = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def __contains__(self, word: bytes) -> bool:
        return pc.index(self.words, word.decode()).as_py() >= 0

    def codes(self, words: pa.Array, learn: Callable) -> np.ndarray:
        """A place in start and length for each string; learn(distinct strings) gives (numbers, starts, lengths) of new ones."""
        if len(self.words) > self.most or self.words.nbytes > self.most_bytes:
            self.clear()
        at = pc.index_in(words, value_set=self.words)
        out = np.asarray(at.fill_null(-1)).astype(np.int64)
        if at.null_count:
            new = words.filter(pc.is_null(at)).dictionary_encode()
            flat, start, length = learn(new.dictionary)
            out[out < 0] = np.asarray(new.indices) + np.int64(len(self.words))
            self.words = pa.concat_arrays([self.words, new.dictionary])
            self.start = np.concatenate((self.start, start + len(self.flat)))
            self.length = np.concatenate((self.length, length))
            self.flat = np.concatenate((self.flat, flat.astype(self.dtype)))
        return out
