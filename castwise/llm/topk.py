"""Operator 8: exact top-k inner products by the threshold algorithm over sorted lists.

Equal rows are made one first; candidates are dealt into shards and queries into blocks by a hash
of id and vector, so that many vectors of one id are spread; a unit is one block against one shard.  A unit sorts its shard once per dimension.  Reading goes on
from both ends of every list in steps of growing depth; vectors first seen in a step get
their whole score.  An unseen vector lies between the last values read in each list, so
its score is at most the sum of the better of both products; a query stops when its k-th
score is above that bound (or everything has been seen).  The k best of every unit are
ranked once more per query.

Defined results: a component x becomes floor(64 * x); vectors that are null or hold null
or non-finite components, and rows without id, take no part; rows equal in id and vector count
once; rows of one id with other vectors are candidates each, of any query but those of their id, and
queries each, whose best are ranked together; vectors of other lengths are no candidates; ties go
to the smaller id; other columns are ignored, whatever their names; scores wrap as 64-bit integers do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK = 8192, 2048


def threshold_top_k(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places (in ids, which ascend and may repeat) of each query's k best; place -1 where there are fewer."""
    n, dims = vectors.shape
    bound = int(max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0)))) * max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))) * max(1, dims))
    scale = n + 1
    wide = bound * scale >= 1 << 62
    kind = np.float64 if bound < 1 << 53 else np.int64
    q, x = queries.astype(kind), vectors.astype(kind)
    lists = np.argsort(vectors, axis=0, kind="stable")
    seen = np.zeros(n, bool)
    none = np.iinfo(np.int64).min
    best = np.full((len(queries), k), none)  # score * scale - place, so that equal scores go to the smaller id
    held = [[] for _ in range(len(queries))] if wide else None
    active, depth, done = np.arange(len(queries)), 0, dims == 0
    while len(active):
        depth = min(n, max(16, 4 * depth))
        new = np.zeros(n, bool)
        if not done:
            new[lists[:depth].ravel()] = True
            new[lists[n - depth :].ravel()] = True
        else:
            new[:] = True
        places = np.flatnonzero(new & ~seen)
        seen |= new
        if len(places):
            for at in range(0, len(active), 512):
                part = active[at : at + 512]
                score = (q[part] @ x[places].T).astype(np.int64)
                if wide:
                    for row, s in zip(part.tolist(), score, strict=True):
                        held[row] = sorted(held[row] + [(-v, p) for v, p in zip(s.tolist(), places.tolist(), strict=True) if ids[p] != query_ids[row]])[:k]
                    continue
                key = score * scale - places
                key[query_ids[part][:, None] == ids[places][None, :]] = none
                key = np.concatenate((best[part], key), axis=1)
                best[part] = np.partition(key, key.shape[1] - k, axis=1)[:, -k:]
        if seen.all():
            break
        low, high = np.take_along_axis(x, lists[depth - 1][None, :], 0)[0], np.take_along_axis(x, lists[n - depth][None, :], 0)[0]
        limit = np.maximum(q[active] * low, q[active] * high).sum(1)
        kth = np.array([-held[r][k - 1][0] if len(held[r]) == k else -np.inf for r in active]) if wide else np.where(best[active].min(1) == none, -np.inf, -((-best[active].min(1)) // scale))
        active = active[~(kth > limit)]
    if wide:
        score = np.array([[-s for s, _ in h] + [0] * (k - len(h)) for h in held], np.int64).reshape(len(queries), k)
        return score, np.array([[p for _, p in h] + [-1] * (k - len(h)) for h in held], np.int64).reshape(len(queries), k)
    score = -((-best) // scale)
    return score, np.where(best == none, -1, score * scale - best)


def top_k(embeddings: DataFrame, k: int = 20, query_every: int = 20, factor: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for every query row (vec_id divisible by query_every)."""
    whole = F.transform("embedding", lambda x: F.floor(factor * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    rows = rows.distinct().withColumn("dims", F.size("v"))
    is_query = F.col("vec_id") % query_every == 0
    n, m = embeddings.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = -(-n // SHARD) or 1, -(-m // BLOCK) or 1
    deal = lambda of: F.pmod(F.xxhash64("vec_id", "v"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    candidates = rows.select(F.lit(False).alias("query"), deal(shards).alias("shard"), every(blocks).alias("block"), "dims", "vec_id", "v")
    queries = rows.where(is_query).select(F.lit(True).alias("query"), every(shards).alias("shard"), deal(blocks).alias("block"), "dims", "vec_id", "v")

    def unit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        values = table.column("v").chunk(0).flatten().to_numpy().reshape(len(ids), -1)

        def distinct(mask):
            order = np.flatnonzero(mask)[np.lexsort((*values[mask].T[::-1], ids[mask]))]
            i, v = ids[order], values[order]
            new = np.append(True, (i[1:] != i[:-1]) | (v[1:] != v[:-1]).any(1))[: len(i)]
            return i[new], v[new]

        (qi, qv), (ci, cv) = distinct(query), distinct(~query)
        if not len(qi) or not len(ci):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        score, place = threshold_top_k(qv, qi, cv, ci, k)
        keep = place >= 0
        return pa.table({"query_id": np.repeat(qi, k)[keep.ravel()], "vec_id": ci[place[keep]], "score": score[keep]})

    found = queries.unionByName(candidates).groupBy("block", "shard", "dims").applyInArrow(unit, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
