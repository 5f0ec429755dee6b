"""Operator 6: a quality classifier of histogram gradient-boosted trees over document statistics.

The model learns on the driver from the statistics of at most SAMPLE labelled rows (those
with the smallest hash of doc_id; the bound is a parameter), never from rows whose
crc32(doc_id as text) mod 4 is 2.  Trees are flattened into arrays of feature, threshold
and child; scoring walks all rows of a batch down a tree at once with numpy.

Defined results: null text is empty; an empty text has all statistics 0 and gets the score
of its leaf; rows without a quality label don't teach; without any label every score is 1;
labels, lang, source and doc_id are no inputs; repeated rows get equal scores; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

SAMPLE = 20_000
KEEP = 0.7
FEATURES = (
    "chars", "words", "mean_word", "letters", "upper", "digits", "spaces", "sentence_marks", "other_marks", "non_ascii",
    "distinct_words", "top_word", "repeated_next", "upper_words", "marked_words", "lines", "mean_line", "repeated_lines", "ended_lines",
)

_CLASS = np.zeros(256, np.int64)  # of a UTF-8 byte
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 5
_CLASS[[b for b in range(33, 127) if not _CLASS[b]]] = 6
_CLASS[128:] = 7
_ENDS = tuple(".?!:;\"')")
_MARKS = bytes(b for b in range(256) if _CLASS[b] == 6 or b == ord("!"))


def statistics(text: bytes) -> list[float]:
    """The FEATURES of a UTF-8 text."""
    if not text:
        return [0.0] * len(FEATURES)
    by = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    chars = len(text)
    lower, upper, digits, spaces, sentence, other, beyond = (by[1:] / chars).tolist()
    words = text.split()
    n = len(words) or 1
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = len(lines) or 1
    top = max(count.values(), default=0)
    marked = sum(c for w, c in count.items() if w[-1:] in _MARKS)
    capitals = sum(c for w, c in count.items() if w.isupper())
    return [
        float(chars), float(len(words)), (chars - int(by[4])) / n, lower + upper, upper, digits, spaces, sentence, other, beyond,
        len(count) / n, top / n if n > 8 else 0.0, sum(map(eq, words, words[1:])) / n, capitals / n, marked / n, float(len(lines)), chars / m, 1 - len(set(lines)) / m, sum(x.endswith(_LINE_ENDS) for x in lines) / m,
    ]


_LINE_ENDS = tuple(e.encode() for e in _ENDS)


def features(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t or b"") for t in column.cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))


@dataclass
class BoostedTrees:
    """Flat arrays over all trees' nodes; a leaf points to itself. Tree t begins at root[t]."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for at in self.root.tolist():
            node = np.full(len(x), at)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 5, smooth: float = 1.0) -> BoostedTrees:
    """Logistic loss; splits are sought on histograms of ``bins`` quantile bins per feature."""
    n, m = x.shape
    if not n or y.min() == y.max():
        one = np.zeros(1, np.int64)
        return BoostedTrees(one, np.full(1, np.inf), one, one, np.zeros(1), one[:0], 1, 40.0 if not n or y[0] else -40.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(m) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def node() -> int:
        at = len(out["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", 0.0)):
            out[k].append(v)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for deep in range(depth + 1):
            after = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                out["value"][at] = rate * gs / (hs + smooth)
                if deep == depth or len(rows) < 2 * least:
                    continue
                cell = flat[rows].ravel()
                hist = [np.bincount(cell, np.repeat(w, m), m * bins).reshape(m, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                (gl, hl, nl) = hist
                gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                goes = binned[rows, j] <= b
                out["feature"][at], out["threshold"][at] = int(j), float(cuts[j][b])
                out["left"][at], out["right"][at] = node(), node()
                after += [(out["left"][at], rows[goes]), (out["right"][at], rows[~goes])]
            for at, rows in level:
                if out["left"][at] == at:
                    total[rows] += out["value"][at]
            level = after
    a = {k: np.array(v) for k, v in out.items()}
    return BoostedTrees(**a, root=np.array(roots), depth=depth, base=base)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """Fit on at most ``sample`` labelled rows; a doc_id with several labels counts with its largest."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    taught = marked.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in slices(batches):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    rows = texts(docs).join(F.broadcast(taught), "doc_id").select("quality", "text").mapInArrow(run, "quality int, x array<double>")
    got = rows.orderBy(F.xxhash64("x"), "quality").limit(2 * sample).toArrow()  # repeated ids can't exceed twice the bound
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("quality").to_numpy().astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = learn(docs, labels, sample)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(batch.column("text"))))], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that score at least ``keep``."""
    model = learn(docs, labels, sample)

    def run(batches):
        for batch in slices(batches):
            good = model.score(features(batch.column("text"))) >= keep
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
