"""Operator 12: substring dedup by difference-cover anchors.

A window is ``words`` consecutive words of one text; every word goes that lies in a window
whose words also occur earlier (by doc_id, then text hash, then place).  An anchor is a run of m words at a
position that is in the cover modulo the period v.  Any two positions have a common offset
below v at which both are in the cover, so with m = words - v + 1 any two equal windows share
an equal anchor at one offset.  Only anchors are hashed and shuffled.

* Equal texts are one: the first stands for all, and copies under other ids go whole.
* Anchors meet by hash.  Each learns an earlier place that has it, if there is one.  Neighbouring
  anchors overlap or touch, so while they point back by the same distance, all of their words
  repeat there: such a run of at least ``words`` words is extended as far as anchors agree, and goes.
* The other windows around repeated anchors (at the ends of runs, and first occurrences) are hashed
  whole and meet by content; all but the first of each go.

Before either shuffle equal keys within a slice of texts are met where they are and only their first is sent, so a
passage that a third of all texts have comes once for some thousand texts.  Texts cross no
shuffle: they are written once, and what is found about them is written by the number of the
file's task (``part``), where the next pass over that file reads it.

Defined results: null and empty texts have no words; a text with fewer than ``words`` words stays; the first
occurrence stays (null ids come first); rows equal in doc_id and text are one document and get
equal results; texts of any length are one row; windows are equal if 128 bits of hashes are; runs, if the 64 bits of each
of their anchors are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running
from ..plans.pin import written
from .common import new_dir, slices, texts
from .token_files import _open
from .words import word_codes

#: Perfect difference sets, period: cover.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

#: Anchors of fewer words than this would be common by chance.
LEAST = 6

KEYED = "k1 long, k2 long, g long, part long, rep long"


def cover_for(words: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words of an anchor): the longest period whose anchors are long enough and leave no gap."""
    for period in sorted(COVERS, reverse=True):
        cover, m = COVERS[period], words - period + 1
        gap = max(b - a for a, b in zip(cover, (*cover[1:], period + cover[0]), strict=True))
        if period == 1 or m >= max(gap, LEAST):
            return period, cover, m
    raise ValueError(words)


def _factors(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


def sequences(codes: np.ndarray, words: list[bytes], at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hashes of the n words from each place on."""
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))[codes]
    out = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(_factors(n, seed)):
        out += hashed[at + k] * factor
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def met_here(k1: np.ndarray, k2: np.ndarray, g: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """The rows as KEYED.  Of equal keys the first has its own g as rep; the others have the first's and keys of their own."""
    order = np.lexsort((g, k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(g), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(g) else new
    rep = np.full(len(g), -1, np.int64)
    rep[order] = np.where(many, g[order][np.flatnonzero(new)[group]], -1)
    later = (rep >= 0) & (rep < g)
    return pa.RecordBatch.from_arrays([pa.array(np.where(later, g, k1)), pa.array(np.where(later, 1, k2)), pa.array(g), pa.array(part), pa.array(rep, mask=rep < 0)], ["k1", "k2", "g", "part", "rep"])


def met(rows: DataFrame) -> DataFrame:
    """part, g, rep (an earlier place of equal key, null for the first) of all KEYED rows that are not alone with their key."""
    same = Window.partitionBy("k1", "k2").orderBy("g")
    earlier = F.when(F.col("rep") < F.col("g"), F.col("rep")).when(F.first("g").over(same) < F.col("g"), F.first("g").over(same))
    out = rows.select("part", "g", "rep", earlier.alias("_r"), F.lead("g").over(same).alias("_next"))
    return out.where("_r IS NOT NULL OR _next IS NOT NULL OR rep IS NOT NULL").select("part", "g", F.col("_r").alias("rep"))


def write_parts(rows: DataFrame, order: str) -> str:
    """Rows with a column ``part``, in one folder per part of the shared folder."""
    path = new_dir(rows.sparkSession, "parts")
    rows.repartition("part").sortWithinPartitions("part", order).write.partitionBy("part").parquet(path)
    return path


class Parts:
    """What write_parts wrote, read part by part in a task (the last two are kept)."""

    def __init__(self, uri: str, *columns: str):
        self.uri, self.columns, self.kept = uri, columns, {}

    def of(self, part: int) -> list[np.ndarray]:
        """The columns, sorted by the first (null: -1)."""
        if part not in self.kept:
            fs, root = _open(self.uri)
            found = fs.get_file_info(pafs.FileSelector(f"{root}/part={part}", allow_not_found=True))
            tables = []
            for f in found:
                if f.path.endswith(".parquet"):
                    with fs.open_input_file(f.path) as source:
                        tables.append(pq.ParquetFile(source).read(list(self.columns)))
            read = [np.concatenate([np.asarray(t[c].combine_chunks().fill_null(-1), dtype=np.int64) for t in tables] or [np.empty(0, np.int64)]) for c in self.columns]
            order = np.argsort(read[0], kind="stable")
            if len(self.kept) > 1:
                self.kept.pop(next(iter(self.kept)))
            self.kept[part] = [x[order] for x in read]
        return self.kept[part]


COPY, REPEATED = -2, -1


def bases(place: np.ndarray, notes: Parts) -> np.ndarray:
    """For each row the words of all texts before it; REPEATED for a document's other rows; COPY where nothing is noted."""
    out, part = np.full(len(place), COPY, np.int64), place >> 33
    for p in np.unique(part).tolist():
        known, base = notes.of(p)
        rows = np.flatnonzero(part == p)
        at = np.minimum(np.searchsorted(known, place[rows]), max(len(known) - 1, 0))
        if len(known):
            hit = known[at] == place[rows]
            out[rows[hit]] = base[at[hit]]
    return out


def marks(place: np.ndarray, base: np.ndarray, n: np.ndarray, table: Parts) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, columns) of a table's entries (first column: g) that lie in the rows' words."""
    rows, out = [], [[] for _ in table.columns]
    for p in np.unique(place >> 33).tolist():
        columns = table.of(p)
        own = np.flatnonzero((place >> 33 == p) & (base >= 0))
        first, last = np.searchsorted(columns[0], base[own]), np.searchsorted(columns[0], base[own] + n[own])
        count = last - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        rows.append(np.repeat(own, count))
        for o, c in zip(out, columns, strict=True):
            o.append(c[at])
    join = lambda x: np.concatenate(x or [np.empty(0, np.int64)])
    return join(rows), [join(o) for o in out]


def runs(row: np.ndarray, g: np.ndarray, rep: np.ndarray, base: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of each stretch of at least ``words`` words that anchors show to repeat an earlier one."""
    period, cover, m = cover_for(words)
    back = rep >= 0
    row, g, rep = row[back], g[back], rep[back]
    pos = g - base[row]
    index = pos // period * len(cover) + np.searchsorted(cover, pos % period)
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (np.diff(index) != 1) | (np.diff(g - rep) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(g)) - 1
    if not len(g):
        return row, pos, pos
    long = pos[last] + m - pos[first] >= words
    return row[first[long]], pos[first[long]], pos[last[long]] + m


def spread(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True at all places in one of the stretches [first, end)."""
    steps = np.bincount(first, minlength=size + 1) - np.bincount(end, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def anchors(batch: pa.RecordBatch, notes: Parts, words: int) -> pa.RecordBatch:
    """KEYED rows of a slice's anchors."""
    period, cover, m = cover_for(words)
    place = np.asarray(batch.column("place"))
    base = bases(place, notes)
    rows = np.flatnonzero(base >= 0)
    codes, ends, known = word_codes(batch.column("text").take(pa.array(rows)))
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(rows)), n)
    pos = np.arange(len(codes)) - ends[:-1][doc]
    at = np.flatnonzero(np.isin(pos % period, cover) & (pos + m <= n[doc]))
    rows = rows[doc[at]]
    return met_here(sequences(codes, known, at, m, 0), np.zeros(len(at), np.int64), base[rows] + pos[at], place[rows] >> 33)


def windows(batch: pa.RecordBatch, notes: Parts, links: Parts, words: int) -> pa.RecordBatch:
    """KEYED rows of the windows that hold a repeated anchor and lie in no run."""
    m = cover_for(words)[2]
    place, n = np.asarray(batch.column("place")), np.asarray(batch.column("n_words"))
    base = bases(place, notes)
    row, (g, rep) = marks(place, base, n, links)
    some = np.unique(row)
    codes, ends, known = word_codes(batch.column("text").take(pa.array(some)))
    start = np.zeros(len(place), np.int64)
    start[some] = ends[:-1]
    pos = g - base[row]
    first, last = np.maximum(pos - (words - m), 0), np.minimum(pos, n[row] - words)
    fits = last >= first
    around = spread(len(codes), (start[row] + first)[fits], (start[row] + last + 1)[fits])
    r, a, z = runs(row, g, rep, base, words)
    at = np.flatnonzero(around & ~spread(len(codes), start[r] + a, start[r] + z - words + 1))
    rows = some[np.searchsorted(ends, at, side="right") - 1]
    return met_here(sequences(codes, known, at, words, 1), sequences(codes, known, at, words, 2), base[rows] + at - start[rows], place[rows] >> 33)


def kept_words(batch: pa.RecordBatch, notes: Parts, links: Parts, later: Parts, words: int) -> pa.RecordBatch:
    """place, doc_id, n_words, n_removed, kept of a slice's rows (but those of a document met before)."""
    place, n = np.asarray(batch.column("place")), np.asarray(batch.column("n_words"))
    base = bases(place, notes)
    base[(base == COPY) & (n < words)] = REPEATED - 2  # too short to be noted
    row, (g, rep) = marks(place, base, n, links)
    r, a, z = runs(row, g, rep, base, words)
    row, (g, _) = marks(place, base, n, later)
    r, a, z = np.concatenate([r, row]), np.concatenate([a, g - base[row]]), np.concatenate([z, g - base[row] + words])
    order = np.argsort(r, kind="stable")
    r, a, z = r[order], a[order], z[order]
    first, end = np.searchsorted(r, np.arange(len(n))), np.searchsorted(r, np.arange(len(n)), side="right")
    kept, gone = [], []
    for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        own, go = text.split(), 0
        if base[i] == COPY:
            own, go = [], len(own)
        elif end[i] > first[i]:
            lost = spread(len(own), a[first[i] : end[i]], z[first[i] : end[i]])
            own, go = list(compress(own, (~lost).tolist())), int(lost.sum())
        kept.append(b" ".join(own))
        gone.append(go)
    out = pa.RecordBatch.from_arrays([batch.column("place"), batch.column("doc_id"), batch.column("n_words"), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["place", "doc_id", "n_words", "n_removed", "kept"])
    return out.filter(pa.array(base != REPEATED))


def _with_words(batches):
    for batch in slices(batches):
        yield batch.append_column("n_words", pa.array([len(t.split()) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.int64()))


def substring_dedup(docs: DataFrame, words: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by single spaces) of every row."""
    spark = docs.sparkSession
    counted = texts(docs).withColumn("th", F.xxhash64("text")).withColumn("th2", F.xxhash64(F.lit(1), "text"))
    counted = counted.mapInArrow(_with_words, "doc_id long, text string, th long, th2 long, n_words long").withColumn("place", F.monotonically_increasing_id())
    path = new_dir(spark, "texts")
    counted.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(counted.schema).parquet(path)

    # the first document of each text, and the words of all such documents before it
    able = table.where(F.col("n_words") >= words).select("place", "doc_id", "th", "th2", "n_words")
    first = able.groupBy("th", "th2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.min("n_words").alias("n_words")).select("th", "th2", "first.doc_id", "first.place", "n_words")
    first = written(running(first, [F.asc_nulls_first("doc_id"), "th", "th2"], {"base": "n_words"}))
    mine = first.select(F.col("th").alias("_th"), F.col("th2").alias("_th2"), F.col("doc_id").alias("_doc"), F.col("place").alias("first"))
    same = (F.col("th") == F.col("_th")) & (F.col("th2") == F.col("_th2")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("place") != F.col("first"))
    again = written(able.join(mine, same).select("place", "first"))
    of_part = F.shiftright("place", 33).alias("part")
    notes = first.select("place", "base", of_part).unionByName(again.select("place", F.lit(REPEATED).cast("long").alias("base"), of_part))
    notes = Parts(write_parts(notes, "place"), "place", "base")

    def passed(columns, schema, f, *tables):
        def run(batches):
            for batch in slices(batches):
                out = f(batch, *tables, words)
                if out.num_rows:
                    yield out

        return table.select(*columns).mapInArrow(run, schema)

    links = Parts(write_parts(met(passed(["place", "text"], KEYED, anchors, notes)), "g"), "g", "rep")
    later = met(passed(["place", "n_words", "text"], KEYED, windows, notes, links)).where("rep IS NOT NULL")
    later = Parts(write_parts(later, "g"), "g", "rep")
    out = passed(["place", "doc_id", "n_words", "text"], "place long, doc_id long, n_words long, n_removed long, kept string", kept_words, notes, links, later)
    rest = ["doc_id", "n_words", "n_removed", "kept"]
    if again.isEmpty():
        return out.select(*rest)
    repeated = out.join(again.select(F.col("first").alias("place")), "place")
    return out.select(*rest).unionByName(repeated.select(*rest))


SUBSTRING_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 20], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)),
f AS (SELECT x, min((doc_id, i)) AS first FROM w GROUP BY x),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i + 1, i + 21))))) AS gone FROM w JOIN f USING (x) WHERE (doc_id, i) <> first GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda v, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
