"""Operator 13: the prefix trie of conversations by prefix-doubling names.

Every turn gets a dense name, its number among the distinct (role, text) pairs.  A block of
2^k turns that begins at a multiple of 2^k is named by the number of its two halves' names
among all such pairs, so after log2(longest) rounds every conversation has one name, and
these names sort as the sequences do.  The prefix of d turns is made up of one block for
each bit of d; it is named in the round of its lowest bit, from the name of the prefix
without that block and the block's name.  Equal names at one depth are one node.  All
numbers come from range partitions and prefix sums; no conversation and no group of equal
ones is gathered.

In the order of the conversations' names a node's members are neighbours, from ``lo`` to
``hi``, and nodes by (lo, depth) are in preorder.  A subtree is a stretch of it, which
ends with the node at which conversation ``hi`` ends: its sums are differences of running sums.

Defined results: a null role or text is empty; turns come in order of turn (null first),
those with one turn number by the hash of (role, text); repeated rows are repeated turns; rows without
conv_id take no part; an empty table gives no rows; two turns are equal if 128 bits of hashes
are; other columns are ignored; texts of any length only ever cross as hashes.  One task hashes the ids that end at one
node as they stream by in order (SHA-256 can't be split); it holds none of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered, running
from ..plans.pin import written

EMPTY = hashlib.sha256().hexdigest()


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n: its turns; conv_id, i from 0, k1, k2: the turn's hash, chars: code points of its text), both written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"), F.length(text).cast("long").alias("chars")).where("conv_id IS NOT NULL")
    rows = written(numbered(rows, "conv_id", F.asc_nulls_first("turn"), "k1", "k2", name="g", spread=True).drop("turn"))
    sizes = written(rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("g").alias("first")))
    turns = rows.join(sizes, "conv_id").select("conv_id", (F.col("g") - F.col("first")).alias("i"), "k1", "k2", "chars")
    return sizes.drop("first"), written(turns)


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h = crc32(c) % heads turns replaced by those of conversation c - c % block."""
    sizes, turns = numbered_turns(conversations)
    convs = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("_lent"))
    convs = written(convs.join(lent, "base", "left").withColumn("m", F.least("h", F.coalesce("_lent", F.lit(0)))).select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("i >= h").withColumn("i", F.col("i") - F.col("h") + F.col("m"))
    head = turns.where(F.col("i") < heads - 1).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("i < h")
    keep = ["conv_id", "i", "k1", "k2", "chars"]
    return convs.select("conv_id", "n"), written(own.select(*keep).unionByName(head.select(*keep)))


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """rows with x: the number of their key among the distinct ones, in the keys' order."""
    return rows.join(numbered(rows.select(*key).distinct(), *key, name="x"), list(key))


def blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each k up to the first with one block for all: conv_id, i, x, the names of blocks of 2^k turns (the last filled up with name 0)."""
    out = [written(_named(turns, "k1", "k2").select("conv_id", "i", "x"))]
    while 1 << (len(out) - 1) < longest:
        half = lambda bit: F.coalesce(F.max(F.when(F.col("i") % 2 == bit, F.col("x"))), F.lit(0))
        pair = out[-1].groupBy("conv_id", F.shiftright("i", 1).alias("j")).agg(half(0).alias("a"), half(1).alias("b"))
        out.append(written(_named(pair, "a", "b").select("conv_id", F.col("j").alias("i"), "x")))
    return out


def prefixes(convs: DataFrame, named: list[DataFrame]) -> DataFrame:
    """conv_id, depth, node for every prefix of every conversation; node 0 is the root."""
    known = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"))
    nodes = 0
    for k in reversed(range(len(named))):
        # the blocks of 2^k turns that end a prefix: those at even places, if they are whole
        block = named[k].where("i % 2 = 0").join(convs, "conv_id").where(F.shiftleft(F.col("i") + 1, k) <= F.col("n")).select("conv_id", F.shiftleft("i", k).alias("depth"), F.col("x").alias("block"))
        longer = block.join(known, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), "node", "block")
        new = written(_named(longer, "depth", "node", "block").select("conv_id", "depth", (F.col("x") + nodes).alias("node")))
        nodes = new.agg(F.max("node")).first()[0] or nodes
        known = known.unionByName(new)
    return known


def _digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of its conv_ids in order; a task hashes them as they come by, whatever their number."""

    def run(batches):
        node, state, nodes, digests = None, None, [], []
        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = n, hashlib.sha256(b"%d" % c)
                else:
                    state.update(b",%d" % c)
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "ends_sha256": pa.array(digests, pa.string())})
            nodes, digests = [], []
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "ends_sha256": [state.hexdigest()]})

    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes, from convs (conv_id, n) and turns (conv_id, i, k1, k2, chars) as numbered_turns gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 for each node.
    """
    longest = convs.agg(F.max("n")).first()[0] or 0
    named = blocks(turns, longest) if longest else []
    top = convs.join(named[-1].select("conv_id", "x"), "conv_id", "left") if named else convs.withColumn("x", F.lit(0))
    places = written(numbered(top.select("conv_id", "n", F.coalesce("x", F.lit(0)).alias("x")), "x", "conv_id", name="place").drop("x"))
    members = written(prefixes(convs, named).join(places, "conv_id"))
    nodes = written(members.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("place").alias("lo"), F.max("place").alias("hi")))
    above = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    last = turns.select("conv_id", (F.col("i") + 1).alias("depth"), "chars")
    told = nodes.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left")
    told = written(told.withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).drop("chars"))
    children = told.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    told = told.join(children, "node", "left").fillna(0, ["n_children"]).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    told = written(running(told, ["lo", "depth"], {"leaves_before": "leaf", "saved_before": "saved"}))
    ends = members.where("depth = n").select("node", "conv_id", "place")
    to_here = told.select("node", (F.col("leaves_before") + F.col("leaf")).alias("leaves_to"), (F.col("saved_before") + F.col("saved")).alias("saved_to"))
    until = ends.join(to_here, "node").select(F.col("place").alias("hi"), "leaves_to", "saved_to")
    parents = told.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = told.join(until, "hi").join(parents, "parent", "left").join(_digests(ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_to") - F.col("leaves_before")).alias("n_leaves"), (F.col("saved_to") - F.col("saved_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


#: CRC-32 of a string of ASCII characters s, byte by byte with the table ``tb.t``.
CRC_TABLE_SQL = "tb AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"

TRIE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS r, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(range(len(s)), lambda j: ascii(s[j + 1])::BIGINT)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT conv_id, conv_id::VARCHAR AS s, count(*) AS n FROM t GROUP BY conv_id), tb),
cc AS MATERIALIZED (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
rb AS MATERIALIZED (SELECT cc.conv_id, r AS i, role, text FROM cc JOIN t ON t.conv_id = cc.base AND r < h UNION ALL SELECT cc.conv_id, r - h + m, role, text FROM cc JOIN t ON t.conv_id = cc.conv_id AND r >= h),
pk AS (SELECT conv_id, 0::BIGINT AS d, '' AS key, 0::BIGINT AS chars FROM c UNION ALL SELECT pk.conv_id, d + 1, md5(key || md5(role) || md5(text)), length(text) FROM pk JOIN rb ON rb.conv_id = pk.conv_id AND rb.i = d),
p AS MATERIALIZED (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS is_end, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM pk),
n AS MATERIALIZED (SELECT key, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM p GROUP BY key, d),
k AS MATERIALIZED (SELECT n.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.up = n.key AND x.d = n.d + 1) AS n_children FROM n LEFT JOIN n q ON q.key = n.up AND q.d = n.d - 1),
su AS (SELECT a.key, a.d, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens FROM k JOIN p a ON a.conv_id = k.conv_id AND a.d <= k.d GROUP BY a.key, a.d)
SELECT conv_id, k.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM k JOIN su ON su.key = k.key AND su.d = k.d
"""
