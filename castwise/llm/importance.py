"""Operator 11: importance resampling towards a target, with n-gram features by CRC algebra.

A feature is a run of 1 to ``max_n`` words joined by spaces, its bucket the CRC-32 of its
bytes modulo ``buckets``.  A word's CRC is computed once; the CRC of a run follows from
that of the run without its last word: a shift by the length added (a 32 x 32 matrix over
GF(2), the power of the matrix for one zero byte, applied through four tables) and the CRC of
what is added.  No run is ever made as a string.

A bucket's gain tells how much likelier it is in the target than in the documents; a
document's weight is the mean gain of its features, and Gumbel noise drawn from its id makes the
highest scores a sample without replacement.  Counts cover all features of all texts; only
the buckets' counts go to the driver and back (``buckets`` numbers each).  The order of scores comes
from range partitions, so no task sees all of them.

Defined results: a null text has no words; texts of any length are one row; every row is a document, so repeated
rows are drawn one by one; ties go to the smaller doc_id (null first), beyond that in any
order; a null doc_id is written as nothing where the noise is drawn; empty tables give no rows or
gains from the other table alone; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..plans.pin import written
from .common import packed, slices, text_hash, texts, unpacked
from .prefix_trie import CRC_TABLE_SQL
from .words import word_codes

#: Letters, digits and all of non-ASCII are words; A-Z become a-z.
TABLE = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))

#: Fixed value: the polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _tables(columns: np.ndarray) -> np.ndarray:
    """What a matrix gives for each value of each of the four bytes."""
    value, out = np.arange(256), np.zeros((4, 256), np.uint32)
    for j, column in enumerate(columns):
        out[j // 8][(value >> (j % 8) & 1) == 1] ^= column
    return out


@lru_cache(maxsize=64)
def _doubled(k: int) -> np.ndarray:
    """The columns of the shift by 2^k bits."""
    if k == 0:
        return np.array([POLYNOMIAL, *(1 << j for j in range(31))], np.uint32)
    half = _doubled(k - 1)
    return _apply(_tables(half), half)


@lru_cache(maxsize=4096)
def shift(length: int) -> np.ndarray:
    """Tables that shift a CRC by ``length`` bytes (4 x 256 numbers)."""
    columns, k = np.uint32(1) << np.arange(32, dtype=np.uint32), 3
    while length:
        if length & 1:
            columns = _apply(_tables(_doubled(k)), columns)
        length, k = length >> 1, k + 1
    return _tables(columns)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC shifted by its own length."""
    out, order = np.empty_like(crc), np.argsort(length, kind="stable")
    values, first = np.unique(length[order], return_index=True)
    for n, rows in zip(values.tolist(), np.split(order, first[1:]), strict=False):  # no values: one empty part
        out[rows] = _apply(shift(n), crc[rows])
    return out


def run_crcs(codes: np.ndarray, ends: np.ndarray, words: list[bytes], max_n: int):
    """For n = 1 .. max_n: (CRCs of the runs of n words, ends of the texts among them)."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    spaced = shifted(np.full(len(words), zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
    runs, at = crc[codes], np.arange(len(codes))  # at: where a run begins
    last_of = np.repeat(ends[1:], np.diff(ends))
    for n in range(1, max_n + 1):
        if n > 1:
            fits = at + n <= last_of[at]
            runs, at = runs[fits], at[fits]
            added = codes[at + n - 1]
            runs = shifted(runs, size[added] + 1) ^ spaced[added]
        yield runs, np.searchsorted(at, ends)


def bucket_counts(docs: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for crc, _ in run_crcs(*word_codes(batch.column("text"), TABLE), max_n):
                total += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one added to every count."""
    size, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, max_n: int) -> DataFrame:
    """doc_id, th, n_words, n_features, weight for every row."""

    def weigh(batches):
        for batch in slices(batches):
            codes, ends, words = word_codes(batch.column("text"), TABLE)
            total, n = np.zeros(len(ends) - 1, np.int64), np.zeros(len(ends) - 1, np.int64)
            for crc, stops in run_crcs(codes, ends, words, max_n):
                sums = np.concatenate(([0], np.cumsum(gain[crc % len(gain)])))
                total += np.diff(sums[stops])
                n += np.diff(stops)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.diff(ends)), pa.array(n), pa.array(weight)], ["doc_id", "th", "n_words", "n_features", "weight"])

    return texts(docs).withColumn("th", text_hash()).mapInArrow(weigh, "doc_id long, th long, n_words long, n_features long, weight long")


def noise(seed: str) -> Column:
    """floor(1000 x) of a Gumbel variable drawn from the document's id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_scores(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """doc_id, th, n_words, n_features, weight, score and, for the floor(percent * N / 100) drawn of the N documents with enough words, rank from 1."""
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    scored = written(weights(docs, gain, max_n).withColumn("score", F.col("weight") + noise(seed)))
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = numbered(able, F.desc("score"), F.asc_nulls_first("doc_id"), name="rank", spread=True)
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return order.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows and columns of docs that are drawn (of equal rows, all if one is)."""
    drawn = importance_scores(docs, target, **parameters).where("rank IS NOT NULL").select(F.struct("doc_id", "th").alias("_drawn")).distinct()
    rows = packed(docs).withColumn("_key", F.struct("doc_id", "th"))
    return unpacked(rows.join(drawn, F.col("_key").eqNullSafe(F.col("_drawn")), "left_semi"), docs.columns)


IMPORTANCE_SQL = rf"""
WITH {CRC_TABLE_SQL},
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w FROM d),
w AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM b)),
cr AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM w, tb),
sc AS (SELECT bucket, count(*) AS s FROM dw JOIN cr USING (w) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM b JOIN cr USING (w) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM sc FULL JOIN tc USING (bucket)),
v AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN cr USING (w) JOIN g USING (bucket) GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id::VARCHAR), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN v ON v.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM s LEFT JOIN r ON r.doc_id = s.doc_id
"""
