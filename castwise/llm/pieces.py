"""Operator 9: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they
make, leftmost first among equals; the best pair is merged and its new neighbours enter
the agenda, until none is left.  Symbols without a piece fall back to their UTF-8 bytes.
Short units are done many at once: each is a row of a matrix with its own agenda (the rank
of the pair that begins at each place), and all rows take their best pair in one step.

No piece of such a vocabulary has a word mark after another character, or a line feed, so
no merge crosses those places: a text is cut there into units, equal units are encoded
once per worker, and the units' ids are joined.  A unit is cut once more after its
letters if no piece holds the two characters that meet there.  Every unit whose agenda
was run, and the shortest text of each Arrow slice, is checked against the sentencepiece
library.

Defined results: null text is empty; an empty text has no ids and decodes to an empty
text; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import gather, slices, texts
from .words import Known

MARK = "\u2581"  # stands for a space
#: Words, and parts of them, that a worker remembers (caches: results don't depend on them).
CACHE_UNITS = 1_000_000
FIRST_CHAR = 1 << 21
NONE = 1 << 40
#: Units up to the last width go through agendas(), in groups of like length.
WIDTHS = (4, 8, 12, 16, 24, 32)
_WORD_END = re.compile(f"{MARK}*[^\\W\\d_]+")
_UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class MergeEncoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        normal, merge = model.SentencePiece.NORMAL, model.trainer_spec.BPE
        spec = model.normalizer_spec
        kinds = {model.SentencePiece.UNUSED, model.SentencePiece.USER_DEFINED}
        if model.trainer_spec.model_type != merge or model.trainer_spec.treat_whitespace_as_suffix or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or spec.precompiled_charsmap.strip(b"\0") or any(p.type in kinds for p in model.pieces):
            raise ValueError("a merge-type model with an identity normalizer and a space before the text is needed")
        self.piece = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("a piece crosses a word mark or a line feed")
        self.inside = {p[k : k + 2] for p in self.piece for k in range(len(p) - 1)}
        self.order = {p.piece: -p.score for p in model.pieces if p.type == normal}
        fallback = {p.piece: i for i, p in enumerate(model.pieces) if p.type == model.SentencePiece.BYTE}
        unknown = next(i for i, p in enumerate(model.pieces) if p.type == model.SentencePiece.UNKNOWN)
        self.byte = [fallback.get(f"<0x{b:02X}>", unknown) for b in range(256)] if fallback else None
        self.unknown = unknown
        self.cache, self.units, self.parts = (Known(np.int32, CACHE_UNITS) for _ in range(3))
        # Symbols: a piece is its id; any other character is FIRST_CHAR plus its code point.
        char = np.arange(0x110000, dtype=np.int64) + FIRST_CHAR
        for p, i in self.piece.items():
            if len(p) == 1:
                char[ord(p)] = i
        self.char = char
        symbol = lambda x: self.piece.get(x, FIRST_CHAR + ord(x) if len(x) == 1 else None)
        place = {o: r for r, o in enumerate(sorted(set(self.order.values())))}
        pairs = sorted((symbol(p[:k]) << 32 | symbol(p[k:]), place[self.order[p]], i) for p, i in self.piece.items() for k in range(1, len(p)) if symbol(p[:k]) is not None and symbol(p[k:]) is not None)
        self.pair, self.pair_rank, self.pair_made = (np.array(x or [0], np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [], [])))
        self.said = pa.array(map(str, range(len(model.pieces))))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: they make no piece) and piece of pairs of symbols; a negative symbol is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NONE), self.pair_made[at]

    def agendas(self, units: list[str], width: int) -> list[list[int]]:
        """agenda() of many units of at most ``width`` characters."""
        n = len(units)
        points = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le"), "<u4").reshape(n, width)
        size = np.fromiter(map(len, units), np.int64, n)
        live = np.arange(width) < size[:, None]
        symbol = np.full((n, width + 2), -1, np.int64)  # one empty place at either end
        symbol[:, 1:-1] = np.where(live, self.char[points], -1)
        before = np.tile(np.arange(width + 2) - 1, (n, 1))
        after = np.tile(np.arange(width + 2) + 1, (n, 1))
        rank = np.full((n, width + 2), NONE)
        rank[:, :-1] = self._pairs(symbol[:, :-1], symbol[:, 1:])[0]
        rows = np.arange(n)
        while len(rows):
            best = rank[rows].argmin(1)
            going = rank[rows, best] < NONE
            rows, left = rows[going], best[going]
            right = after[rows, left]
            follows, leads = after[rows, right], before[rows, left]
            made = self._pairs(symbol[rows, left], symbol[rows, right])[1]
            symbol[rows, left], symbol[rows, right] = made, -1
            rank[rows, right] = NONE
            after[rows, left], before[rows, follows] = follows, left
            rank[rows, left] = self._pairs(made, symbol[rows, follows])[0]
            rank[rows, leads] = self._pairs(symbol[rows, leads], made)[0]
        keep = symbol >= 0
        flat, ends = symbol[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if (symbol >= FIRST_CHAR).any():
            out = [[y for s in x for y in self._fallback(s)] if max(x, default=0) >= FIRST_CHAR else x for x in out]
        return out

    def _fallback(self, symbol: int) -> list[int]:
        if symbol < FIRST_CHAR:
            return [symbol]
        return [self.byte[b] for b in chr(symbol - FIRST_CHAR).encode()] if self.byte else [self.unknown]

    def agenda(self, unit: str) -> list[int]:
        """Ids of a unit in which spaces are marks already."""
        order, symbol = self.order, list(unit)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(order[p], i, i + 1, len(p)) for i in range(n - 1) if (p := unit[i : i + 2]) in order]
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbol[left], symbol[right]
            if not a or not b or len(a) + len(b) != size:  # one of them was merged meanwhile
                continue
            symbol[left], symbol[right] = a + b, ""
            after[left] = follows = after[right]
            if follows < n:
                before[follows] = left
                if (p := symbol[left] + symbol[follows]) in order:
                    heapq.heappush(heap, (order[p], left, follows, len(p)))
            if (leads := before[left]) >= 0 and (p := symbol[leads] + symbol[left]) in order:
                heapq.heappush(heap, (order[p], leads, left, len(p)))
        out: list[int] = []
        for s in filter(None, symbol):
            i = self.piece.get(s)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, where each part's begin and their number; parts are not cut any more."""
        known = parts.to_pylist()
        order = sorted(range(len(known)), key=lambda i: len(known[i]))
        new = [known[i] for i in order]
        ids, at, size = [], 0, [len(u) for u in new]
        for width in WIDTHS:
            to = bisect_right(size, width)
            for a in range(at, to, 8192):
                ids += self.agendas(new[a : min(to, a + 8192)], width)
            at = to
        ids += [self.agenda(u) for u in new[at:]]
        feed = self.agenda("\n")
        expected = self.agenda(MARK)
        for x in ids:
            expected += feed + x
        if new and self.library.encode("\n" + "\n".join(new).replace(MARK, " ")) != expected:
            raise RuntimeError("the agenda's ids differ from the library's")
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        start, length = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        start[order], length[order] = np.cumsum(n) - n, n
        return np.fromiter((i for x in ids for i in x), np.int32, int(n.sum())), start, length

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _parts(); a unit that begins with a line feed is that and what follows."""
        parts, many = [], []
        for u in units:
            before = len(parts)
            if u[:1] == "\n":
                parts.append("\n")
                u = u[1:]
            if (m := _WORD_END.match(u)) and (k := m.end()) < len(u) and u[k - 1 : k + 1] not in self.inside:
                parts += (u[:k], u[k:])
            elif u:
                parts.append(u)
            many.append(len(parts) - before)
        code = self.parts.codes(pa.array(parts, pa.string()), self._parts_or_feed)
        flat, n = gather(code, self.parts.start, self.parts.length, self.parts.flat)
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *many])]
        return flat, ends[:-1], np.diff(ends)

    def _parts_or_feed(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feed = np.array(self.agenda("\n"), np.int32)
        is_feed = pc.equal(parts, "\n").to_numpy(zero_copy_only=False)
        flat, own, n = self._parts(parts.filter(pa.array(~is_feed)))
        start, length = np.full(len(parts), len(flat)), np.full(len(parts), len(feed))
        start[~is_feed], length[~is_feed] = own, n
        return np.concatenate((flat, feed)), start, length

    def encode(self, texts: pa.Array) -> tuple[list[list[int]], list[bytes]]:
        """Ids of each text, and the same as decimal numbers joined by commas."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.starts_with(texts, " ")).to_pylist()
        code = self.cache.codes(cut.flatten(), lambda new: self._units([w if w[:1] == "\n" else MARK + w for w in new.to_pylist()]))
        flat, n = gather(code, self.cache.start, self.cache.length, self.cache.flat)
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.asarray(cut.offsets, dtype=np.int64)
        place = ends[place - place[0]].tolist()
        out = []
        for i, size in enumerate(pc.binary_length(texts).to_pylist()):
            if not size:
                out.append(flat[:0])
            elif odd[i]:  # runs of spaces: cut at the marks
                units = pa.array(_UNITS.findall(MARK + texts[i].as_py().replace(" ", MARK)))
                own = self.units.codes(units, lambda new: self._units(new.to_pylist()))
                out.append(gather(own, self.units.start, self.units.length, self.units.flat)[0])
            else:
                out.append(flat[place[i] : place[i + 1]])
        sizes = np.cumsum([0, *map(len, out)])
        said = pa.LargeListArray.from_arrays(pa.array(sizes), self.said.take(pa.array(np.concatenate([flat[:0], *out]))))
        ids = [x.tolist() for x in out]
        probe = min((i for i, x in enumerate(ids) if x), key=lambda i: len(ids[i]), default=None)
        if probe is not None and self.library.encode(texts[probe].as_py()) != ids[probe]:
            raise RuntimeError("a text's ids differ from the library's")
        return ids, pc.binary_join(said, ",").cast(pa.large_binary()).to_pylist()


@lru_cache(maxsize=1)
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def sentencepiece_round_trip(docs: DataFrame, model: str, with_results: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_results adds ids and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_results

    def both(batches):
        coder = encoder(model)
        for batch in slices(batches):
            ids, said = coder.encode(batch.column("text"))
            back = coder.library.decode(ids, num_threads=1)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(map(len, ids), pa.int64()), "ids_sha256": [hashlib.sha256(s).hexdigest() for s in said], "decoded_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in back]}
            if with_results:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": back}
            yield pa.RecordBatch.from_pydict(columns)

    return texts(docs).mapInArrow(both, schema)
