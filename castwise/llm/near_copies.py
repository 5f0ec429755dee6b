"""Operator 3 for copies that are less alike: one document of each group of near copies, by SimHash and BK-trees.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of
at least 0.8.  Words are SimHash's (operator 3): A-Z lowered, cut at white space; fewer than
five words are one shingle, none are the empty set, whose texts are linked with each other.

Fingerprints are SimHashes of 128 bits over a set's shingles: at 0.8 two differ in 19 bits on
average with a deviation of 4, so the radius of 38 misses a pair with a chance of 2e-6, while
unrelated ones (64 and 5.7) are within it with one of 3e-6.  No blocks of bits can deal out such a radius, so
the shards of the BK-trees are keyed by shingles instead: a set is in the shards of its least
hashes, the first n - ceil(0.8 n) + 1 of n, of which two similar sets always share one, or the
first LEAST where that is more; then a pair at 0.8 shares none with a chance of about
0.2 ** LEAST, 1e-11.  Whatever a tree finds is checked exactly on the whole sets; sets are equal or not by 64-bit hashes.

First every set is compared with its shards' leaders (of a shard the set whose hashes most
others share), which grows with the rows only and joins most shards.  In a shard that is not one
component then, a BK-tree of its fingerprints tells which sets may have a partner of another
component, and those are checked; a large shard is cut into pieces, and each two pieces go to one
task, which returns links that join what it found, never all pairs.

Defined results: as operator 3 for null texts, null ids, long texts and other columns; the first (doc_id, th) of a component stays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, slices, text_hash, texts
from .components import components
from .simhash import BKTree, one_each, search

WORDS, SIMILARITY = 5, 0.8
LEAST = 16
#: Bits of two 128-bit fingerprints that may differ.
RADIUS = 38
#: Hashes in a piece of a large group.
PIECE = 1 << 19
#: Fingerprints in a piece of a large group; in a group that is searched point by point.
TREE, SMALL = 1024, 24
#: Rows of points that may be broadcast.
FEW = 200_000


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles (UTF-8), signed."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.int64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """The 128-bit SimHash of a set of 64-bit hashes, as two signed numbers; the second comes from the hashes scrambled once more."""
    one = hashes.view(np.uint64)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(one), 4096):
        h = one[at : at + 4096]
        other = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        other = (other ^ other >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        both = np.stack([h, other ^ other >> np.uint64(32)], 1)
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    a, b = np.packbits(2 * ones > len(one), bitorder="little").view("<i8").tolist()
    return a, b


def sketches(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, th, key (of the set), n (its size), a, b (its fingerprint), low (the hashes of its shards)."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_hashes(text)
                posts = min(LEAST, len(s), len(s) - math.ceil(similarity * len(s) - 1e-9) + 1)
                rows.append((xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s), *fingerprint(s), s[:posts]))
            key, n, a, b, low = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _lists(low)], ["doc_id", "th", "key", "n", "a", "b", "low"])

    return texts(docs).withColumn("th", text_hash()).mapInArrow(run, "doc_id long, th long, key long, n int, a long, b long, low array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, hashes of the wanted (key, first) points; each key comes once."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists([shingle_hashes(t) for t in batch.column("text").cast(pa.binary()).to_pylist()])], ["key", "hashes"])

    rows = texts(docs).withColumn("th", text_hash())
    of = wanted.select("key", F.col("first.doc_id").alias("of_id"), F.col("first.th").alias("of_th"))
    if of.count() <= FEW:
        of = F.broadcast(of)
    rows = rows.join(of, (rows.th == of.of_th) & rows.doc_id.eqNullSafe(of.of_id)).select("key", "text")
    return rows.mapInArrow(run, "key long, hashes array<long>").dropDuplicates(["key"])


def unit_links(keys: np.ndarray, roots: np.ndarray, values: np.ndarray, ends: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different roots that are similar enough and join all that are."""
    code = np.unique(values, return_inverse=True)[1]
    size = np.diff(ends)
    of = [code[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    mark = np.zeros(len(values) + 1, bool)
    rest, out = np.arange(len(keys)), []
    while len(rest):
        mine = roots[rest] == roots[rest[0]]
        todo, rest = rest[mine].tolist(), rest[~mine]
        flat = None
        while todo and len(rest):
            x = todo.pop()
            if flat is None:
                flat, starts = np.concatenate([of[i] for i in rest]), np.cumsum([0, *size[rest[:-1]]])
            mark[of[x]] = True
            common = np.add.reduceat(mark[flat].astype(np.int64), starts)
            mark[of[x]] = False
            hit = common >= similarity * (size[rest] + size[x] - common) - 1e-9
            if hit.any():
                out += [(int(keys[x]), int(k)) for k in keys[rest[hit]]]
                joined = np.isin(roots[rest], roots[rest[hit]])
                todo += rest[joined].tolist()
                rest, flat = rest[~joined], None
    return out


def live_places(roots: np.ndarray, sizes: np.ndarray, prints: np.ndarray, similarity: float, radius: int = RADIUS) -> np.ndarray:
    """Which sets (with their fingerprints, two unsigned words a row) have a partner of another root that could be similar enough."""
    whole = [a | b << 64 for a, b in prints.tolist()]
    _, of, often = np.unique(roots, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(of != often.argmax())  # of two roots one at least isn't the most frequent
    tree = BKTree(whole)
    at = {p: i for i, p in enumerate(tree.points)}
    place = np.array([at[w] for w in whole], np.int64)
    members = np.argsort(place, kind="stable")  # sets of equal fingerprints, one after another
    first = np.searchsorted(place[members], np.arange(len(tree.points) + 1))
    live = np.zeros(len(roots), bool)
    if len(roots) <= SMALL:
        for x in asking.tolist():
            for t in tree.within(whole[x], radius):
                for y in members[first[t] : first[t + 1]].tolist():
                    if roots[x] != roots[y] and min(sizes[x], sizes[y]) >= similarity * max(sizes[x], sizes[y]) - 1e-9:
                        live[x] = live[y] = True
        return live
    flat = tree.flat(2)
    for begin in range(0, len(asking), 64):
        part = asking[begin : begin + 64]
        for q, t in search(flat, prints[part], radius):
            n = first[t + 1] - first[t]
            q, end = np.repeat(part[q], n), np.cumsum(n)
            t = members[np.arange(end[-1]) + np.repeat(first[t] - (end - n), n)]
            least, most = np.minimum(sizes[q], sizes[t]), np.maximum(sizes[q], sizes[t])
            could = (roots[q] != roots[t]) & (least >= similarity * most - 1e-9)
            live[q[could]] = live[t[could]] = True
    return live


def _could(n: Column, m: Column, a: Column, b: Column, c: Column, d: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles with fingerprints (a, b) and (c, d) could be similar enough."""
    apart = F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (apart <= RADIUS)


def _leader_links(posted: DataFrame, points: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    fame = posted.groupBy("key").agg(F.sum("members").alias("fame"))
    lead = posted.join(fame, "key").groupBy("h").agg(F.max(F.struct("fame", "key", "n", "a", "b")).alias("of")).select("h", F.col("of.key").alias("leader"), *(F.col(f"of.{c}").alias(f"lead_{c}") for c in "nab"))
    could = _could(*(F.col(c) for c in ("n", "lead_n", "a", "b", "lead_a", "lead_b")), similarity)
    pairs = pinned(posted.join(lead, "h").where("key <> leader").where(could).select("key", "leader").distinct())
    sets = pinned(whole_sets(docs, points.select("key", "first").join(pairs.select("key").unionByName(pairs.select(F.col("leader").alias("key"))).distinct(), "key", "left_semi")))
    led = pairs.join(sets, "key").withColumnRenamed("hashes", "own").join(sets.select(F.col("key").alias("leader"), "hashes"), "leader")
    common = F.size(F.array_intersect("own", "hashes"))
    both = led.select("key", "leader", common.alias("common"), (F.size("own") + F.size("hashes")).alias("sizes"))
    return pinned(both.where(F.col("common") >= similarity * (F.col("sizes") - F.col("common")) - 1e-9).select(F.col("key").alias("a"), F.col("leader").alias("b")))


def _group_links(posted: DataFrame, roots: DataFrame, points: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    rooted = posted.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_groups = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.greatest(F.sum("n") / PIECE, F.count("*") / TREE)).cast("int").alias("pieces")).where("x <> y").select("h", "pieces")
    own = F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")
    other = F.explode(F.expr("if(pieces = 1, array(0), filter(sequence(0, pieces - 1), x -> x <> own))"))
    units = rooted.join(open_groups, "h").withColumn("own", own).withColumn("other", other).select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "root", "n", "a", "b")

    def live(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        prints = np.stack([column("a").view(np.uint64), column("b").view(np.uint64)], 1)
        keep = live_places(column("root"), column("n").astype(np.int64), prints, similarity)
        return table.select(["h", "i", "j", "key", "root"]).filter(pa.array(keep))

    def unit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        chunk = table.column("hashes").chunk(0)
        ends = np.asarray(chunk.offsets).astype(np.int64)
        links = unit_links(table.column("key").to_numpy(), table.column("root").to_numpy(), chunk.flatten().to_numpy(), ends - ends[0], similarity)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    units = pinned(units.groupBy("h", "i", "j").applyInArrow(live, "h long, i int, j int, key long, root long"))
    sets = pinned(whole_sets(docs, points.select("key", "first").join(units.select("key").distinct(), "key", "left_semi")))
    return pinned(units.join(sets, "key").groupBy("h", "i", "j").applyInArrow(unit, "a long, b long"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th, key and component: first (doc_id, th) of the row's component, null ids last."""
    prints = pinned(sketches(docs, similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    points = pinned(prints.groupBy("key").agg(first.alias("first"), *(F.first(c).alias(c) for c in ("n", "a", "b", "low"))))
    posting = points.select("key", "n", "a", "b", F.explode("low").alias("h"))
    # shards with the same members (families of copies share most of their least hashes) are one
    same = (F.bit_xor(F.xxhash64("key")).alias("s1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("s2"))
    shared = posting.groupBy("h").agg(F.count("*").alias("members"), *same).where("members > 1")
    shared = shared.groupBy("members", "s1", "s2").agg(F.min("h").alias("h")).select("h", "members")
    posted = pinned(posting.join(shared, "h"))
    led = _leader_links(posted, points, docs, similarity)
    rest = _group_links(posted, components(led), points, docs, similarity)
    joined = components(led.unionByName(rest))
    roots = points.join(joined, points.key == joined.node, "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    firsts = roots.groupBy("root").agg(F.min("first").alias("component"))
    return prints.select("doc_id", "th", "key").join(roots.join(firsts, "root").select("key", "component"), "key")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, one for each component: that of its first (doc_id, th)."""
    return one_each(docs, classes(docs, similarity))
