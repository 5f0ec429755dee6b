"""Operator 2: I-Match document fingerprints, in DataFrame functions only.

Terms are runs of letters and digits, lower-cased.  The lexicon holds the terms whose
document frequency over all distinct texts lies within a band (so neither very frequent nor
rare terms count, which is what an edit mostly changes).  SUBSETS random parts of the
lexicon are drawn by hash, some larger for short texts and some smaller for long ones; for
each part, a text's distinct terms in it are sorted and hashed.  The fingerprint is those hashes in a row, 8 hex digits each ('........' if the
text has no term in the part).  The likeness of two fingerprints is the share of equal hashes among the parts
that either text has terms in; two fingerprints without any are alike only if equal.

The band alone makes the lexicon, whatever its size: up to LEXICON terms it is sent to all
tasks, beyond it is joined by shuffle.

A large group of near copies pushes its terms out of the band, all but those of private edits.  So
a text with under SPARSE of its distinct terms in the lexicon has the parts drawn from all its terms.

Defined results: null text is empty; a text without any term gets one hash
of itself in every part, an empty one empty parts; the
row after another is the next distinct (doc_id, text) downwards, null ids last, and the
first after the last; equal rows are one document but each is returned; a text of any length is
one array of its distinct terms' hashes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, text_hash, texts

#: (parts, one term in so many is in a part): parts of one size don't share terms.
SIZES = ((8, 16), (12, 64), (12, 256))
SUBSETS = sum(n for n, _ in SIZES)
LOW, HIGH = 0.002, 0.05
#: Terms of a lexicon that is broadcast.
LEXICON = 200_000
SPARSE = 1 / 8
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def bound(value: Column, of) -> Column:
    """of(value) with value evaluated once, however often it occurs there."""
    return F.transform(F.array(value), of)[0]


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The terms of the band."""
    n = docs.select("th").distinct().count()
    frequency = pinned(docs.select("th", "text").dropDuplicates(["th"]).select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df > 1"))
    return frequency.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term")


def known(words: DataFrame) -> DataFrame:
    """The lexicon for a join: broadcast if it has at most LEXICON terms."""
    marked = words.withColumn("_in", F.lit(True))
    return F.broadcast(marked) if words.count() <= LEXICON else marked


def subset_hashes(used: Column, other: Column) -> Column:
    """SUBSETS hashes of the sorted terms in each part, null for a part without; ``other`` in each if there are no terms."""

    def hashes(terms: Column, k: int, n: int, rate: int) -> Column:
        small = F.filter(terms, lambda t: F.pmod(F.shiftright(t, 9 * k), F.lit(rate)) < n)

        def one(own: Column) -> Column:
            return F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(0xFFFFFFFF))

        def every(terms: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: bound(F.filter(terms, lambda t: F.pmod(F.shiftright(t, 9 * k), F.lit(rate)) == j), one))

        return bound(small, every)

    each = bound(F.sort_array(used), lambda terms: F.concat(*(hashes(terms, k, n, rate) for k, (n, rate) in enumerate(SIZES))))
    return F.when(F.size(used) > 0, each).otherwise(F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), lambda j: other))


def prints(rows: DataFrame, text: str, words: DataFrame, *also: str) -> DataFrame:
    """k, th, also, hashes for each (k, th): the fingerprint of the column ``text``.

    Exploded terms meet the lexicon (``words``, as known() gives it); a text's first term is kept in any case, so
    that every text has a row, and brings the parts of all its terms; the rest of a text's terms outside the lexicon go at once.
    """
    own = terms(F.col(text))
    itself = F.when(F.col(text) != "", F.xxhash64(text).bitwiseAND(0xFFFFFFFF))
    told = rows.select("k", "th", *also, text, own.alias("_terms")).select("k", "th", *also, F.size("_terms").alias("_n"), subset_hashes(F.col("_terms"), itself).alias("_all"), "_terms")
    told = told.select("k", "th", *also, "_n", "_all", F.posexplode_outer("_terms").alias("_at", "term"))  # by itself: else all is done for each term
    told = told.withColumn("_all", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_all")))
    met = told.join(words, "term", "left").where("_in or coalesce(_at, 0) = 0")
    group = met.groupBy("k", "th").agg(*(F.first(c).alias(c) for c in (*also, "_n")), F.first("_all", ignorenulls=True).alias("_all"), F.collect_set(F.when(F.col("_in"), F.col("term"))).alias("_used"))
    sparse = (F.size("_used") == 0) | (F.size("_used") < SPARSE * F.col("_n"))
    return group.select("k", "th", *also, F.when(sparse, F.col("_all")).otherwise(subset_hashes(F.col("_used"), F.lit(None).cast("long"))).alias("hashes"))


def shown(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 8, "0")), F.lit("........"))), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)).cast("int")))
    told = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(told) == 0, F.lit(1.0)).otherwise(F.aggregate(told, F.lit(0), lambda s, x: s + x) / F.size(told))


def _key(prefix: str = "") -> list[Column]:
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias(f"{prefix}k"), F.col("th").alias(f"{prefix}th")]


def following(docs: DataFrame) -> DataFrame:
    """k, th, next_k, next_th, n for each distinct (doc_id, th): which comes next downwards, and n_chars.

    Rows are range-partitioned by the order, so each partition knows all successors but
    its last row's; that is the first row of the next partition, of which there is one each.
    """
    rows = docs.select(*_key(), F.length("text").alias("n")).distinct()
    order = [F.desc("k"), F.desc("th")]
    placed = pinned(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("p")))
    here = F.struct("k", "th")
    inside = placed.withColumn("next", F.lead(here).over(Window.partitionBy("p").orderBy(*order)))
    first = placed.groupBy("p").agg(F.max(here).alias("first"))  # a row for each partition
    whole = Window.orderBy("p")
    first = first.select("p", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole)).alias("after"))
    linked = inside.join(first, "p").withColumn("next", F.coalesce("next", "after"))
    return linked.select("k", "th", F.col("next.k").alias("next_k"), F.col("next.th").alias("next_th"), "n")


def imatch(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = texts(docs).withColumn("th", text_hash())
    words = known(pinned(lexicon(docs, low, high)))
    after = pinned(following(docs))
    own = pinned(prints(docs.select(*_key(), "text"), "text", words))
    rows = docs.select(*_key(), "text").repartition("k", "th")
    if docs.count() > after.count():  # repeated rows: one of each, or two documents that follow each other would multiply
        rows = rows.dropDuplicates(["k", "th"])
    wanted = after.select(F.col("k").alias("of_k"), F.col("th").alias("of_th"), F.col("next_k").alias("k"), F.col("next_th").alias("th"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    given = rows.join(wanted, ["k", "th"]).select(F.col("of_k").alias("k"), F.col("of_th").alias("th"), F.expr("substring(text, 1, take)").alias("head"))
    kept = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))")
    joined = rows.join(given, ["k", "th"]).select("k", "th", F.length("text").cast("long").alias("n_chars"), F.concat(kept, "head").alias("edited"))
    joined = joined.withColumn("sha", F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)))
    edited = prints(joined, "edited", words, "n_chars", "sha").withColumnRenamed("hashes", "other")
    follows = after.select("k", "th", "next_k", "next_th").join(own.select(F.col("k").alias("next_k"), F.col("th").alias("next_th"), F.col("hashes").alias("next_own")), ["next_k", "next_th"]).select("k", "th", "next_own")
    result = edited.join(own, ["k", "th"]).join(follows, ["k", "th"]).select("k", "th", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), shown(F.col("hashes")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"), likeness(F.col("hashes"), F.col("other")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_own")).alias("near_next"))
    return docs.select("doc_id", *_key()).join(result, ["k", "th"]).drop("k", "th")
