"""Operator 1: line dedup by winnowing over line hashes.

A text is the sequence of its lines with words (white space within a line counts as one
space).  A window is a shortest stretch of lines with at least ``min_words`` words, from
each line onwards and up to each line.  The smallest line hash of a window (the rightmost
of equal ones) is its fingerprint, so equal stretches of that many words always share a
selected fingerprint.  Fingerprints seen at one position only are dropped; the positions
of the others are joined.  A position's match is extended both ways by the windows around
it: a window whose whole content has been seen earlier (in order of doc_id, text hash and line) is a repeat,
and overlapping repeats make up a repeated run, which is deleted with the blank lines in
it.  Earlier positions are found by minimum per key, so no pairs are made.  Fingerprints and contents
are hashed apart, so two stretches are equal if 128 bits are.

Defined results: exactly the lines in a run of at least ``min_words`` words that occurs
earlier go; the first occurrence stays; null ids come first in the order; null and empty texts stay as
they are; a text may become empty; rows equal in doc_id and text lose the same lines; a text of any length is
one row, its windows two for each line at most; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, pinned, slices, text_hash, texts, unpacked

MIN_WORDS = 5


def windows(text: bytes, min_words: int = MIN_WORDS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(fingerprint, [(first line << 32 | last line, content hash)]) of each selected position."""
    place, hashes, others, ends = [], [], [], [0]
    for i, line in enumerate(text.split(b"\n")):
        if words := line.split():
            place.append(i)
            line = b" ".join(words)
            hashes.append(xxhash.xxh64_intdigest(line))
            others.append(xxhash.xxh64_intdigest(line, 1))
            ends.append(ends[-1] + len(words))
    n, spans = len(place), set()
    stop = start = 0
    for i in range(n):
        stop = max(stop, i)
        while stop < n and ends[stop + 1] - ends[i] < min_words:
            stop += 1
        if stop < n:
            spans.add((i, stop))
        while ends[i + 1] - ends[start + 1] >= min_words:
            start += 1
        if ends[i + 1] - ends[start] >= min_words:
            spans.add((start, i))
    chosen: dict[int, list[tuple[int, int]]] = {}
    for i, j in spans:
        if i == j:
            at, whole = i, others[i]
        else:
            least = min(hashes[i : j + 1])
            at = max(k for k in range(i, j + 1) if hashes[k] == least)
            whole = xxhash.xxh64_intdigest(np.array(others[i : j + 1], "<u8").tobytes(), at - i)
        chosen.setdefault(at, []).append((place[i] << 32 | place[j], whole))
    return [(hashes[at], w) for at, w in chosen.items()]


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, runs (array of first, last line; disjoint and in order) for each text with repeats."""

    def run(batches):
        for batch in slices(batches):
            doc, prints, spans, contents, sizes = [], [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                for fingerprint, own in windows(text, min_words):
                    doc.append(i)
                    prints.append(fingerprint)
                    sizes.append(len(own))
                    spans += [s for s, _ in own]
                    contents += [c for _, c in own]
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            pair = pa.StructArray.from_arrays([pa.array(spans, pa.int64()), signed(contents)], ["span", "content"])
            at = pa.array(doc, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), signed(prints), pa.ListArray.from_arrays(offsets, pair)], ["doc_id", "th", "print", "windows"])

    keyed = texts(docs).withColumn("th", text_hash())
    prints = pinned(keyed.mapInArrow(run, "doc_id long, th long, print long, windows array<struct<span: long, content: long>>"))
    again = pinned(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))  # so that the join reads two exchanges and a hot line's rows are split
    around = prints.join(again, "print").select("doc_id", "th", "print", F.explode("windows").alias("w"))
    around = pinned(around.select("doc_id", "th", "print", "w.content", "w.span"))
    here = F.struct(F.col("doc_id"), F.col("th"), F.col("span"))
    first = pinned(around.groupBy("print", "content").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1"))
    later = around.join(first.select("print", "content", "first"), ["print", "content"]).where(~here.eqNullSafe(F.col("first")))
    line = lambda x: x.cast("int")
    run_of = F.struct(line(F.shiftright("span", 32)).alias("first"), line(F.col("span").bitwiseAND(0xFFFFFFFF)).alias("last"))
    spans = later.select("doc_id", "th", run_of.alias("run")).distinct()
    # overlapping and touching runs are one: a run begins where no earlier one reaches
    text = Window.partitionBy("doc_id", "th").orderBy("run.first", "run.last")
    reach = F.max("run.last").over(text.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("_n", F.sum(F.when(F.coalesce(reach, F.lit(-2)) + 1 < F.col("run.first"), 1).otherwise(0)).over(text))
    merged = begun.groupBy("doc_id", "th", "_n").agg(F.min("run.first").alias("first"), F.max("run.last").alias("last"))
    return merged.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _cut(docs: DataFrame, min_words: int) -> DataFrame:
    """packed() rows with _cut (the new text, null where nothing goes), _lines and _removed."""
    runs = repeated_runs(docs, min_words).select(F.struct("doc_id", "th").alias("_run_key"), "runs")
    rows = packed(docs).withColumn("_key", F.struct("doc_id", "th"))
    joined = rows.join(runs, rows["_key"].eqNullSafe(runs["_run_key"]), "left").withColumn("_all", F.split("text", "\n"))
    # lines before the first run, between runs and after the last; runs are disjoint and in order
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["last"] + 1)
    kept = F.transform("runs", lambda r, i: F.slice("_all", before(i) + 1, r["first"] - before(i)))
    tail = F.element_at("runs", -1)["last"] + 1
    left = F.concat(F.flatten(kept), F.slice("_all", tail + 1, F.size("_all") - tail))
    out = joined.withColumn("_left", F.when(F.col("runs").isNotNull(), left))
    removed = F.when(F.col("_left").isNull(), 0).otherwise(F.size("_all") - F.size("_left"))
    lines = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size("_all"))
    return out.select("_row", F.array_join("_left", "\n").alias("_cut"), lines.alias("_lines"), removed.alias("_removed"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of docs with repeated runs cut out of text (and n_chars as it is then); _lines and _removed count lines (where docs has a column of that name, its own stays)."""
    return unpacked(_cut(docs, min_words), docs.columns, F.col("_cut"), *(F.col(c) for c in ("_lines", "_removed") if c not in docs.columns))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their lines deduplicated and n_chars as it is then; a text that lost all its words goes."""
    out = _cut(docs, min_words).where("_cut IS NULL OR _cut RLIKE '[^\\\\s]'")
    return unpacked(out, docs.columns, F.col("_cut"))


#: The rule itself, over all windows: what winnowing and the joins above must give.
LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, array_to_string(list_filter(regexp_split_to_array(ls[i], '[\t-\r ]+'), lambda w: w <> ''), ' ') AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
n AS (SELECT *, len(string_split(t, ' ')) AS k FROM l WHERE t <> ''),
w AS MATERIALIZED (SELECT doc_id, i, t, k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, sum(k) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM n),
f AS (SELECT a.doc_id, a.r AS ra, min(b.r) AS rb FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.r >= a.r AND b.c - a.c + a.k >= 5 GROUP BY ALL),
g AS (SELECT b.doc_id, max(a.r) AS ra, b.r AS rb FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.r >= a.r AND b.c - a.c + a.k >= 5 GROUP BY b.doc_id, b.r),
s AS (SELECT * FROM f UNION SELECT doc_id, ra, rb FROM g),
x AS MATERIALIZED (SELECT s.doc_id, ra, rb, min(w.i) AS ia, max(w.i) AS ib, string_agg(t, chr(10) ORDER BY w.r) AS content FROM s JOIN w ON w.doc_id = s.doc_id AND w.r BETWEEN ra AND rb GROUP BY ALL),
e AS (SELECT content, min((doc_id, ia)) AS first FROM x GROUP BY content),
gone AS (SELECT DISTINCT doc_id, unnest(range(ia, ib + 1)) AS i FROM x JOIN e USING (content) WHERE (doc_id, ia) <> first),
o AS (SELECT doc_id, list(i) AS gs FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gs), 0)::BIGINT AS n_removed,
  CASE WHEN gs IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda v, j: NOT list_contains(gs, j)), chr(10)), '') END AS text
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""
