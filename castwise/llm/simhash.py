"""Operator 3: SimHash near-duplicates, found with BK-trees.

Fingerprint: text with A-Z lowered, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words,
repeats included, joined by a space (fewer words: the whole sequence; none: fingerprint 0);
a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Links join fingerprints that differ in at most ``radius`` bits.  Those agree in at least
two of radius + 2 blocks of bits, so fingerprints (each distinct one once) are dealt into shards by
two blocks and their values: for radius 3 ten shards each, keyed by 25 or 26 bits, so that a
shard of unrelated fingerprints holds about n / 2**25.  A shard's tree keys each child by its
Hamming distance to its parent; a search follows only the edges whose key is within the radius
of its own distance there.  Shards over SHARD fingerprints are cut into pieces, and each
piece's tree is sent to the tasks of the other pieces' searches, so that no task holds a hot
shard.  A task returns a star for each group that it has linked, never all pairs; components()
joins the stars.

Trees and searches take fingerprints of any number of 64-bit words (near_copies.py has two).

Defined results: null text is empty; empty texts are linked with each other; the smallest
doc_id of a component is its id (null only if all are null); a text of any length is one
fingerprint, its shingles counted 4096 at a time; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import packed, pinned, slices, text_hash, texts, unpacked
from .components import components

SHARD = 2048
WORDS = 3


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of one text (UTF-8), as a signed 64-bit number."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp for each row."""

    def run(batches):
        for batch in slices(batches):
            fp = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fp, pa.int64())], ["doc_id", "th", "fp"])

    return texts(docs).withColumn("th", text_hash()).mapInArrow(run, "doc_id long, th long, fp long")


class BKTree:
    """Children are keyed by their integer distance to the parent; flat() allows many searches at once."""

    def __init__(self, points: list[int]):
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []
        for p in points:
            self.insert(p)

    def insert(self, point: int) -> None:
        if self.points:
            at = 0
            while d := (self.points[at] ^ point).bit_count():
                to = self.children[at].get(d)
                if to is None:
                    self.children[at][d] = len(self.points)
                    break
                at = to
            else:
                return
        self.points.append(point)
        self.children.append({})

    def within(self, point: int, radius: int) -> list[int]:
        """Places of the points at most radius away."""
        found, todo = [], [0] if self.points else []
        while todo:
            at = todo.pop()
            d = (self.points[at] ^ point).bit_count()
            if d <= radius:
                found.append(at)
            todo += [to for k, to in self.children[at].items() if d - radius <= k <= d + radius]
        return found

    def flat(self, words: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points (rows of 64-bit words), and edges as sorted numbers step * parent + key with the child of each."""
        step = 64 * words + 1
        edges = sorted((step * at + k, to) for at, c in enumerate(self.children) for k, to in c.items())
        keys, to = zip(*edges, strict=True) if edges else ((), ())
        points = np.array([[p >> 64 * w & (1 << 64) - 1 for w in range(words)] for p in self.points], np.uint64).reshape(-1, words)
        return points, np.array(keys, np.int64), np.array(to, np.int64)


def search(tree: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, radius: int):
    """(query, place) pairs within the radius; a step takes one level of the tree for all queries (rows of words)."""
    points, keys, to = tree
    step = 64 * points.shape[1] + 1
    query, at = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    while len(query):
        d = np.bitwise_count(queries[query] ^ points[at]).sum(1, dtype=np.int64)
        if (hit := d <= radius).any():
            yield query[hit], at[hit]
        low = np.searchsorted(keys, step * at + np.maximum(d - radius, 1))
        n = np.searchsorted(keys, step * at + np.minimum(d + radius, step - 1), side="right") - low
        n = np.maximum(n, 0)
        end = np.cumsum(n)
        edge = np.arange(end[-1]) + np.repeat(low - (end - n), n)
        query, at = np.repeat(query, n), to[edge]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the smallest label, in place."""
    while len(a):
        m = np.minimum(label[a], label[b])
        if (m == label[a]).all() and (m == label[b]).all():
            return
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label[:] = label[label]


def stars(points: np.ndarray, is_tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what one unit's searches have joined: (point, smallest of its group).

    points are distinct unsigned fingerprints; those with is_tree form the tree and the rest
    search it; if all are in the tree, all search it.
    """
    order = np.argsort(points, kind="stable")
    points, is_tree = points[order], is_tree[order]
    places, all_in = np.flatnonzero(is_tree), bool(is_tree.all())
    if not len(places):
        return points[:0], points[:0]
    label = np.arange(len(points))
    tree = BKTree(points[places].tolist())
    if all_in and len(points) <= 24:
        pairs = [(i, j) for i, p in enumerate(points.tolist()) for j in tree.within(p, radius) if j < i]
        if pairs:
            _merge(label, *np.array(pairs).T)
    else:
        flat, searching = tree.flat(), places if all_in else np.flatnonzero(~is_tree)
        for at in range(0, len(searching), 256):
            part = searching[at : at + 256]
            for q, t in search(flat, points[part, None], radius):
                _merge(label, part[q], places[t])
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) links over distinct fingerprints fp that give the components of all pairs within the radius."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    part = [F.shiftrightunsigned(F.shiftleft("fp", 64 - b), 64 - b + a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    values = [F.struct(F.lit(k).alias("block"), F.shiftleft(part[i], 32).bitwiseOR(part[j]).alias("value")) for k, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    dealt = fps.select("fp", F.explode(F.array(*values)).alias("s")).select("fp", "s.block", "s.value")
    shards = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1").select("block", "value", F.ceil(F.col("n") / SHARD).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    units = (
        dealt.join(shards, ["block", "value"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("block", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("tree"), "fp")
    )
    unit = ["block", "value", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out(table):
            key = np.stack([np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in unit])
            points = np.asarray(table.column("fp").combine_chunks()).astype(np.int64).view(np.uint64)
            tree = table.column("tree").combine_chunks().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(points)]
            a, b = zip(*(stars(points[x:y], tree[x:y], radius) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1), strict=True) if any(y - x > 1 for x, y in zip(cuts[:-1], cuts[1:], strict=True)) else ((), ())
            a, b = (np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:  # rows come sorted by unit: the last unit of a batch may go on in the next
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in unit])
            last = int(np.flatnonzero((key != key[:, -1:]).any(0)).max(initial=-1)) + 1
            if held and last == 0 and held[-1].slice(held[-1].num_rows - 1).select(unit).to_pylist() == batch.slice(0, 1).select(unit).to_pylist():
                held.append(batch)
                continue
            if held and last == 0:
                yield out(pa.Table.from_batches(held))
                held = [batch]
                continue
            yield out(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield out(pa.Table.from_batches(held))

    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, th, fp and component: first (doc_id, th) of the row's component, null ids last."""
    prints = pinned(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    distinct = pinned(prints.groupBy("fp").agg(first.alias("first")))
    joined = components(links(distinct.select("fp"), radius))
    roots = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = roots.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(roots.join(firsts, "root").select("fp", "component"), "fp")


def simhash_components(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    return classes(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component.doc_id").alias("component_id"))


def one_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one for each component of ``joined`` (doc_id, th, component)."""
    keep = joined.where(F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("th") == F.col("component.th")))
    keep = keep.select(F.struct("doc_id", "th").alias("_kept")).distinct()
    rows = packed(docs).withColumn("_key", F.struct("doc_id", "th"))
    kept = rows.join(keep, rows["_key"].eqNullSafe(keep["_kept"]), "left_semi")
    one = Window.partitionBy("_key").orderBy(F.lit(0))  # equal rows: one of them
    return unpacked(kept.withColumn("_n", F.row_number().over(one)).where("_n = 1"), docs.columns)


def drop_near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs, all columns, one for each component: that of its first (doc_id, th)."""
    return one_each(docs, classes(docs, radius))
