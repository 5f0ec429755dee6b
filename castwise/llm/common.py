"""Helpers that several operators share: table reading, row keys, shared folders, Arrow slices.

Row identity
    An operator looks at a row of ``documents`` as ``(doc_id, th)``, th being XXH64 of
    the text.  Rows that are equal in both are one document and get equal results, so a
    join of results back to rows never multiplies them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pin import pinned, shared_dir

__all__ = ["SLICE_BYTES", "by_document", "gather", "new_dir", "packed", "pinned", "shared_dir", "slices", "table", "text_hash", "texts", "unpacked"]

#: Bytes of text that a Python worker works on at once (one longer text is taken alone).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only (null text: empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """_row (all columns, so that no name clashes), doc_id, text (null: empty) and th."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return docs.select(row).select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.coalesce("_row.text", F.lit("")).alias("text")).withColumn("th", text_hash())


def unpacked(rows: DataFrame, columns: list[str], text: Column | None = None, *also: Column) -> DataFrame:
    """The columns of packed() rows; where ``text`` isn't null it is the new text, and n_chars its length."""
    out = []
    for c in columns:
        old = F.col(f"_row.`{c}`")
        new = {"text": text, "n_chars": F.length(text).cast("long")}.get(c) if text is not None else None
        out.append((old if new is None else F.when(text.isNotNull(), new).otherwise(old)).alias(c))
    return rows.select(*out, *also)


def text_hash(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        end, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = end[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(end, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def gather(codes: np.ndarray, start: np.ndarray, length: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[start[c] : start[c] + length[c]] for every code c; also the length for each code."""
    n = length[codes]
    if not len(codes):
        return values[:0], n
    end = np.cumsum(n)
    index = np.arange(int(end[-1])) + np.repeat(start[codes] - (end - n), n)
    return values[index], n


def by_document(words: pa.ListArray, n: np.ndarray) -> np.ndarray:
    """Ends of the documents in the gathered values: n counts values for each word."""
    offsets = np.asarray(words.offsets, dtype=np.int64)
    return np.concatenate(([0], np.cumsum(n)))[offsets - offsets[0]]
