"""Operator 7: packing documents into sequences by cutting-stock column generation.

A document's ids (with the end id) are full sequences and a remainder.  The remainders' lengths,
in classes of UNIT ids, give a histogram (at most length / UNIT rows, the only thing that the driver
sees).  A linear program over packing patterns is solved by column generation: each round
prices a new pattern with a knapsack dynamic program on the dual values.  A remainder may also be
cut in two after a whole number of SECTIONs: that is a column of the program too, at a cost of
CUT sequences, so remainders are cut only where the duals say that it saves more padding.  Counts
are rounded down, what is left (at most a pattern per class) is packed first-fit decreasing,
and remainders, ranked within their class, are cut or take the places that the patterns give their class.

Defined results: null text is empty (its end id alone); every row is packed, repeated rows
each; a text of any length is tokenised by itself and cut into full sequences; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, slices, texts
from .word_tokens import encoder

UNIT = 4
#: Where a remainder may be cut, and what a cut costs in sequences.
SECTION, CUT = 512, 0.01


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of items used any number of times, and how often each is used; sizes ascend."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        n = int(np.searchsorted(sizes, w, side="right"))
        if n:
            got = best[w - sizes[:n]] + values[:n]
            i = int(got.argmax())
            if got[i] > best[w]:
                best[w], item[w] = got[i], i
    use, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if item[w] < 0:
            w -= 1
        else:
            use[item[w]] += 1
            w -= int(sizes[item[w]])
    return float(best[capacity]), use


def greedy(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, items of each class) that pack ``left`` pieces of each class, largest first."""
    left, out = left.astype(np.int64).copy(), []
    while left.any():
        room, use = capacity, np.zeros(len(sizes), np.int64)
        for i in np.flatnonzero(left)[::-1]:
            use[i] = min(left[i], room // sizes[i])
            room -= int(use[i] * sizes[i])
        t = int((left[use > 0] // use[use > 0]).min())
        left -= t * use
        out.append((t, use))
    return out


def patterns(demand: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 3000, section: int = 0, cut: float = CUT) -> tuple[list[tuple[int, dict[int, int]]], list[tuple[int, int, int]]]:
    """Patterns (times, {class: items}) and cuts (times, class, where) that pack demand pieces of each class (its size) with little waste.

    A cut makes two pieces of one, at a multiple of ``section`` (0: none).  Ends when the dual bound is within ``gap`` of the program's
    value, or after ``rounds`` (then with more padding); any basis on the way is a whole packing.
    """
    demand = {s: n for s, n in sorted(demand.items()) if n > 0}
    if not demand:
        return [], []
    cuts = [(s, k) for s in demand for k in range(section, s, section)] if section else []
    sizes = np.array(sorted({*demand, *(k for _, k in cuts), *(s - k for s, k in cuts)}))
    at = {int(s): i for i, s in enumerate(sizes)}
    d = np.array([demand.get(int(s), 0) for s in sizes], np.float64)
    whole, first, second = (np.array([at[x] for x in xs], np.int64) for xs in ([s for s, _ in cuts], [k for _, k in cuts], [s - k for s, k in cuts]))
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(np.float64)
    cost, kind = np.ones(m), np.full(m, -1)  # kind: the cut that a column stands for
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ d
    # patterns to begin with: those of packing largest first, with nothing cut and with everything cut at its last section
    parted = d.copy()
    for s in demand if section else ():
        if (k := (s - 1) // section * section) > 0:
            for own, n in ((s, -demand[s]), (k, demand[s]), (s - k, demand[s])):
                parted[at[own]] += n
    pool = np.array([use for n in (d, parted) for _, use in greedy(sizes, n, capacity)], np.float64)
    settled = False
    for _ in range(rounds):
        duals = cost @ inverse
        price, what, known = 1.0, -1, pool @ duals
        saves = duals[whole] - duals[first] - duals[second] - cut if cuts else np.zeros(1)
        if known.max() > 1 + gap:
            use = pool[known.argmax()]
        elif settled and saves.max() > gap:
            what, use, price = int(saves.argmax()), np.zeros(m), cut
            use[whole[what]] += 1
            use[first[what]] -= 1
            use[second[what]] -= 1
        else:
            value, use = knapsack(sizes, np.maximum(duals, 0), capacity)
            if value <= 1 + gap:
                if saves.max() <= gap:
                    break
                settled = True  # whole pieces can do no better: from now on cuts are priced as well
                continue
        step = inverse @ use
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        basis[:, out], cost[out], kind[out] = use, price, what
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    times = np.floor(x + 1e-9).astype(np.int64)
    given = {s: int(n) for s, n in demand.items()}
    for j in np.flatnonzero(kind >= 0):  # only remainders are cut, not what a cut has made
        s = cuts[kind[j]][0]
        times[j] = min(times[j], given[s])
        given[s] -= int(times[j])
    left = d.astype(np.int64) - basis.astype(np.int64) @ times
    for j in np.flatnonzero(kind < 0):  # rounding may ask for a piece too many
        while (left < 0).any() and times[j] and (basis[left < 0, j] > 0).any():
            times[j] -= 1
            left += basis[:, j].astype(np.int64)
    made = [(int(times[j]), {int(s): int(a) for s, a in zip(sizes, basis[:, j].astype(np.int64), strict=True) if a}) for j in np.flatnonzero((kind < 0) & (times > 0))]
    made += [(t, {int(s): int(a) for s, a in zip(sizes, use, strict=True) if a}) for t, use in greedy(sizes, left, capacity)]
    return made, sorted((int(times[j]), *cuts[kind[j]]) for j in np.flatnonzero((kind >= 0) & (times > 0)))


def _ranked_cuts(cuts: list[tuple[int, int, int]], demand: dict[int, int]) -> dict[str, np.ndarray]:
    """For each cut: its class, the first rank that it takes there, where it cuts, and the first ranks of its two pieces in their classes."""
    taken: dict[int, int] = {}
    rows = []
    for times, size, where in sorted(cuts, key=lambda c: c[1:]):
        rows.append([size, taken.get(size, 0), where, times])
        taken[size] = taken.get(size, 0) + times
    rest = {s: n - taken.get(s, 0) for s, n in demand.items()}
    for row in rows:
        for own in (row[2], row[0] - row[2]):
            row.append(rest.get(own, 0))
            rest[own] = rest.get(own, 0) + row[3]
    table = np.array(rows, np.int64).reshape(-1, 6).T
    return dict(zip(("size", "rank", "where", "times", "first", "second"), table, strict=True))


def _places(made: list[tuple[int, dict[int, int]]], first_sequence: int = 0) -> dict[str, np.ndarray]:
    """For each class and pattern: the first rank, items a sequence, first sequence and slot; sorted by class and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], first_sequence
    for times, items in made:
        slot = 0
        for size in sorted(items, reverse=True):
            rows.append((size, rank.get(size, 0), items[size], sequence, slot))
            rank[size] = rank.get(size, 0) + times * items[size]
            slot += items[size]
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("size", "rank", "items", "sequence", "slot"), table, strict=True))


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    capacity = length // UNIT

    def cut(batches):
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, ends = coder.encode(batch.column("text"))
            ids = np.insert(ids, ends[1:], coder.dtype.type(end_id))
            ends = ends + np.arange(len(ends))
            total = np.diff(ends)
            n = -(-total // length)
            doc = np.repeat(np.arange(len(total)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
            size = np.minimum(total[doc] - start, length)
            wide = ids.astype("<u4")
            low = ends[doc] + start
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(low.tolist(), (low + size).tolist(), strict=True)]
            # crc32 of both pieces for every place where a remainder may be cut
            parts = [[zlib.crc32(wide[x:y]) for k in range(a + SECTION, b, SECTION) for x, y in ((a, k), (k, b))] if b - a < length else [] for a, b in zip(low.tolist(), (low + size).tolist(), strict=True)]
            kind = -(-size // UNIT)
            order = np.argsort(kind, kind="stable")
            count = np.bincount(kind, minlength=capacity + 1)
            rank = np.empty(len(kind), np.int64)
            rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(count) - count, count)
            rank += seen[kind]
            seen += count
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(kind), pa.array(np.full(len(kind), part)), pa.array(rank), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "rank", "parts"])

    pieces = pinned(texts(docs).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind long, part long, rank long, parts array<long>"))
    counts = pieces.groupBy("kind", "part").agg(F.count("*").alias("n"))
    histogram = {k: n for k, n in counts.groupBy("kind").agg(F.sum("n")).collect()}  # at most CAPACITY rows
    made, cuts = patterns(histogram, capacity, section=SECTION // UNIT)
    place, cutting = _places(made), _ranked_cuts(cuts, histogram)
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")
    bases = counts.select("kind", "part", before.alias("base"))

    def assign(batches):
        key = place["size"] << 44 | place["rank"]
        spot = cutting["size"] << 44 | cutting["rank"]
        gone = np.zeros(capacity + 1, np.int64)
        np.add.at(gone, cutting["size"], cutting["times"])
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]
        for batch in batches:
            kind, rank, start, size, crc = (np.asarray(batch.column(c)).astype(np.int64) for c in ("kind", "rank", "start", "length", "ids_crc32"))
            split = np.flatnonzero(rank < gone[kind])
            with_ = np.searchsorted(spot, kind[split] << 44 | rank[split], side="right") - 1
            where = cutting["where"][with_]
            nth = rank[split] - cutting["rank"][with_]
            offsets = np.asarray(batch.column("parts").offsets).astype(np.int64)[:-1][split] - batch.column("parts").offsets[0].as_py()
            crcs = np.asarray(batch.column("parts").flatten()).astype(np.int64)
            at = offsets + 2 * (where * UNIT // SECTION - 1)
            rows = np.concatenate((np.arange(len(kind)), split))  # second pieces come after all
            rank = np.concatenate((rank - gone[kind], cutting["second"][with_] + nth))
            rank[split] = cutting["first"][with_] + nth
            start, size = np.concatenate((start, start[split] + where * UNIT)), np.concatenate((size, size[split] - where * UNIT))
            size[split] = where * UNIT
            crc = np.concatenate((crc, crcs[at + 1]))
            crc[split] = crcs[at]
            kind = np.concatenate((kind, kind[split] - where))
            kind[split] = where
            own = np.searchsorted(key, kind << 44 | rank, side="right") - 1
            past, items = rank - place["rank"][own], place["items"][own]
            same = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(same), *map(pa.array, (start, size, crc)), batch.column("doc_tokens").take(same), pa.array(place["sequence"][own] + past // items), pa.array(place["slot"][own] + past % items)], names)

    ranked = pieces.join(bases, ["kind", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank", "parts")
    put = ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    return put.withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("slot")
