"""Operator 5: flat token-id files with 64-bit document offsets, memory-mapped.

Format of a folder: for each part p in ascending doc_id order
    part-p.bin   ids of its documents one after another, unsigned, little-endian (16 bits
                 if the vocabulary has at most 65536 entries, else 32)
    part-p.off   n + 1 signed 64-bit offsets (in ids) of its documents within the part
    part-p.doc   n signed 64-bit doc_ids (null: the smallest)
and manifest.json, which has each part's base: ids in all parts before it, by prefix sum.
A document's place among all ids is its part's base plus its offset.

Defined results: a null text is an empty one; every document ends with ``end_id``; an
empty table gives no parts; rows with one doc_id follow each other by text hash; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, slices, text_hash, texts
from .word_tokens import encoder

NULL_ID = -(1 << 63)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int) -> dict:
    """Write the folder ``out`` (a URI that driver and executors share); returns the manifest.

    A part is written under names of its task attempt and renamed when whole, so a lost
    executor's half-written files are never read and a repeated task changes nothing.
    """

    def write(batches):
        fs, root = _open(out)
        coder = encoder(tokenizer)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        name = f"{root}/part-{part:06d}"
        parts = {x: fs.open_output_stream(f"{name}.{x}.{attempt}") for x in ("bin", "off", "doc")}
        docs = at = 0
        parts["off"].write(np.zeros(1, "<i8").tobytes())
        for batch in slices(batches):
            ids, ends = coder.encode(batch.column("text"))
            n = len(ends) - 1
            ids = np.insert(ids, ends[1:], coder.dtype.type(end_id))
            ends = ends[1:] + np.arange(1, n + 1)
            parts["bin"].write(ids.astype(coder.dtype).tobytes())
            parts["off"].write((ends + at).astype("<i8").tobytes())
            parts["doc"].write(np.asarray(batch.column("doc_id").fill_null(NULL_ID)).astype("<i8").tobytes())
            docs, at = docs + n, at + int(ends[-1])
        for x, f in parts.items():
            f.close()
            if docs:
                fs.move(f"{name}.{x}.{attempt}", f"{name}.{x}")
            else:
                fs.delete_file(f"{name}.{x}.{attempt}")
        if docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "ids": [at], "bytes": [coder.dtype.itemsize]})

    fs, root = _open(out)
    fs.create_dir(root)
    order = [F.col("doc_id"), F.col("th")]
    sorted_docs = texts(docs).withColumn("th", text_hash()).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("th")
    found = sorted(tuple(r) for r in sorted_docs.mapInArrow(write, "part long, docs long, ids long, bytes long").collect())  # a row for each part
    bases = np.concatenate(([0], np.cumsum([r[2] for r in found], dtype=np.int64))).tolist()
    manifest = {"end_id": end_id, "bytes": found[0][3] if found else 2, "documents": sum(r[1] for r in found), "ids": bases[-1], "parts": [{"part": p, "documents": d, "ids": n, "base": b} for (p, d, n, _), b in zip(found, bases, strict=False)]}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file's numbers without a copy: memory-mapped where it is on a mounted file system."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark, out: str, rows_at_once: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document of the folder ``out``, from its files."""
    fs, root = _open(out)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    dtype = f"<u{manifest['bytes']}"

    def read(batches):
        fs, root = _open(out)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, off, doc = (_mapped(fs, f"{root}/part-{part:06d}.{x}", d) for x, d in (("bin", dtype), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, len(doc), rows_at_once):
                    o = np.asarray(off[at : at + rows_at_once + 1])
                    d = np.asarray(doc[at : at + rows_at_once])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == NULL_ID), pa.array(o[:-1] + base), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = [(p["part"], p["base"]) for p in manifest["parts"]]
    at = spark.createDataFrame(parts, "part long, base long")
    return at.repartition(max(1, len(parts))).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None) -> DataFrame:
    """Write, then read back; ``out`` defaults to a new folder in the shared one."""
    spark = docs.sparkSession
    out = out or new_dir(spark, "tokens")
    write_token_files(docs, out, tokenizer, end_id)
    return read_token_files(spark, out)
