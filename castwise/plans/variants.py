"""The lattice of variants (model x aggregation) as key columns of one plan, not a loop over plays.

Models: full takes all on stage; p-speaking leaves mutes out; s-speaking takes a segment's speakers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of a play of which all subsets are told (2 ** 20 - 1); those that rewrite alike are computed once.
MAX_GROUPS = 20
MODELS = {"full": (True, "stage"), "p-speaking": (False, "stage"), "s-speaking": (False, "speaking")}


def mutes(cast: DataFrame, speakers: DataFrame) -> DataFrame:
    """play_id, char_id of those on stage who speak nowhere in the play."""
    return cast.select("play_id", "char_id").distinct().join(speakers.select("play_id", "char_id").distinct(), ["play_id", "char_id"], "left_anti")


def model_casts(cast: DataFrame, speakers: DataFrame) -> DataFrame:
    """model, play_id, seg_id, char_id."""
    heard = speakers.select("play_id", "char_id").distinct()
    key = ["play_id", "seg_id", "char_id"]
    full = cast.select(F.lit("full").alias("model"), *key)
    present = cast.join(heard, ["play_id", "char_id"], "left_semi").select(F.lit("p-speaking").alias("model"), *key)
    return full.unionByName(present).unionByName(speakers.select(F.lit("s-speaking").alias("model"), *key).distinct())


def labels(plays: DataFrame, label: Column, cut: int = 16, author: Column | None = None) -> DataFrame:
    """play_id, label, collides: names cut to ``cut`` characters; where another play of the corpus has the same, the author is added."""
    short = F.when(F.length(label) > cut, F.concat(F.substring(label, 1, cut - 1), F.lit("…"))).otherwise(label)
    collides = F.count("*").over(Window.partitionBy("label")) > 1
    rows = plays.select("play_id", short.alias("label"), (F.lit(None).cast("string") if author is None else author).alias("_author")).withColumn("collides", collides)
    told = F.when(F.col("collides") & (F.coalesce("_author", F.lit("")) != ""), F.concat(F.col("_author"), F.lit(" "), F.col("label"))).otherwise(F.col("label"))
    return rows.select("play_id", told.alias("label"), "collides")


def masks(plays: DataFrame, groups: Column, keep: bool = False) -> DataFrame:
    """play_id, mask, groups (and chosen, an array): the non-empty subsets of an array of groups, one row for each bit mask.

    Their number doubles with each group; a play with over MAX_GROUPS is refused with an error.
    """
    small = F.when(F.size("_all") <= MAX_GROUPS, F.size("_all")).otherwise(F.raise_error(F.format_string("%s has over %d groups", F.col("play_id").cast("string"), F.lit(MAX_GROUPS))))
    own = plays.withColumn("_all", groups).where(F.size("_all") > 0).withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2), small) - 1).cast("long"))))
    rows = own.withColumn("chosen", F.filter("_all", lambda g, i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0))
    return rows.select("play_id", "mask", F.array_join("chosen", ",").alias("groups"), *(["chosen"] if keep else []))
